"""Query catalog, one module per area of SURVEY section 2."""

_LOADED = False


def load_all():
    global _LOADED
    if _LOADED:
        return
    from . import corpus, encode, io, metrics, ml, order, streaming, tasks  # noqa: F401

    _LOADED = True
