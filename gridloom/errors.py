"""Error classes: each says which part of a request was wrong."""


class GridloomError(Exception):
    """Base of all errors raised on purpose."""


class ArgumentError(GridloomError, ValueError):
    """An argument, or a combination of arguments, is not allowed."""


class SourceError(GridloomError):
    """A raster could not be opened or read."""


class GeometryError(GridloomError, ValueError):
    """A box, polygon or covering is not usable."""


class ResolutionError(ArgumentError):
    """A grid resolution is out of range."""
