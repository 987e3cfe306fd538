"""Finding, explaining and planning the removal of duplicate records with Spark.

Names are loaded on first use: Python workers import the package for its column functions and should
not pay for the rest.
"""

from importlib import import_module

_WHERE = {
    "functions.bits": ["dhash9x8", "hamming", "hamming_hex", "phash_from_hex", "phash_hex"],
    "functions.paths": ["human_size", "normalize_ext", "verdict"],
    "functions.raster": ["flatten_on_white", "pair_scores", "raster_hashes", "to_gray"],
    "operators.clean": ["plan_clean", "plan_deletions", "reconcile"],
    "operators.compare": ["compare_pairs", "with_raster_hashes"],
    "operators.find": ["find", "find_batch"],
    "operators.group": ["prune_pixel_hash", "scan"],
    "operators.hamming": ["similar_pairs"],
    "operators.index": ["cache_hits", "cache_misses", "collect_garbage", "index", "orphans", "refresh"],
    "operators.names": ["unique_paths"],
    "sources.images": ["folder_rasters", "hash_folder", "list_images"],
    "sources.text": ["hashed_texts", "text_records"],
    "sources.vectors": ["hashed_vectors", "vector_rasters"],
    "streaming.ingest": ["index_stream", "open_retries", "stream_images"],
}
_MODULE_OF = {name: module for module, names in _WHERE.items() for name in names}
__all__ = sorted(_MODULE_OF)


def __getattr__(name: str):
    if name not in _MODULE_OF:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_MODULE_OF[name]}"), name)
