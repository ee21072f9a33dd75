"""What can go wrong, by the part that says so."""


class GraphloomError(Exception):
    pass


class ParsingError(GraphloomError):
    """A template document or a query that does not follow the grammar."""


class ResolutionError(GraphloomError):
    """An unknown or contradictory prefix."""


class TypingError(GraphloomError):
    """Templates whose parameter types contradict each other, unknown or recursive templates."""


class MappingError(GraphloomError):
    """A frame that does not fit its template."""


class SparqlError(GraphloomError):
    """A query that cannot be answered."""


class UnsupportedQuery(SparqlError):
    pass
