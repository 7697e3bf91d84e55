"""dupscan: a PySpark-native engine that finds duplicate and similar images at scale."""

__version__ = "0.1.0"


def __getattr__(name: str):
    """build and search, loaded when they are asked for: Python workers that need a module of dupscan don't load the rest."""
    if name in ("build", "search", "ImageRepo", "SearchResult"):
        from dupscan import api

        return getattr(api, name)
    raise AttributeError(name)
