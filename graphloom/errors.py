"""What the engine raises."""


class ParseError(ValueError):
    """The text is no query."""


class UnsupportedQuery(ValueError):
    """The query is well formed but outside the accepted surface."""


class UnknownProperty(ValueError):
    """A predicate that the graph does not hold."""
