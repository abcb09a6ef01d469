"""Errors that tell a user what is wrong with a request before any data is read."""


class FeedError(ValueError):
    """A file, layout or request that cannot be read as asked."""


class WhereError(FeedError):
    """A ``where`` expression that does not compile against a layout."""
