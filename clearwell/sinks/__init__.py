from .writers import LoadResult, get_sink, list_sinks, load, register_sink  # noqa: F401
