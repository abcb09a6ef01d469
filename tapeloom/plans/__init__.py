"""Compilers: the ``where`` language and JSON run specs."""
