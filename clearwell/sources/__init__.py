from .registry import get_source, list_sources, register_source  # noqa: F401
