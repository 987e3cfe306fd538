"""Path, format and display expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinsift.schemas import FORMAT_ALIASES


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_extensions(csv: str) -> list[str]:
    """``"jpg, PNG"`` -> ``["jpg", "png"]``."""
    return [part.strip().lower() for part in csv.split(",")]


def extension(path: Column | str) -> Column:
    """Lowercase text after the last dot of the last path segment; empty when there is none."""
    return F.lower(F.regexp_extract(_col(path), r"\.([^./\\]+)$", 1))


def normalize_ext(ext: Column | str, aliases: dict[str, str] = FORMAT_ALIASES) -> Column:
    """Lowercase extension with aliases folded together (jpg is jpeg, tif is tiff)."""
    low = F.lower(_col(ext))
    out = F
    for alias, name in aliases.items():
        out = out.when(low == alias, name)
    return out.otherwise(low)


def has_extension(path: Column | str, extensions) -> Column:
    return extension(path).isin([e.lower() for e in extensions])


def relative_path(path: Column | str, root: str) -> Column:
    """Path below ``root`` with ``/`` as the only separator; unrelated paths are kept whole."""
    prefix = root.replace("\\", "/").rstrip("/") + "/"
    clean = F.replace(_col(path), F.lit("\\"), F.lit("/"))
    return F.when(clean.startswith(prefix), F.substring(clean, len(prefix) + 1, 1 << 30)).otherwise(clean)


def plain_uri(path: Column | str) -> Column:
    """Give ``file:///x`` and ``file:/x`` the same spelling."""
    return F.regexp_replace(_col(path), "^([a-zA-Z][a-zA-Z0-9+.-]*):/+(?=[^/])", "$1:/")


def path_is_safe(path: Column | str) -> Column:
    """True when no segment is empty, ``.`` or ``..``. Null counts as unsafe."""
    inner = F.concat(F.lit("/"), _col(path), F.lit("/"))
    bad = inner.contains("//") | inner.contains("/./") | inner.contains("/../")
    return F.coalesce(~bad, F.lit(False))


def inside_root(path: Column | str, root: str | None) -> Column:
    """Fail-closed guard for removal targets: below ``root`` and free of odd segments."""
    path = _col(path)
    if root is None:
        return path_is_safe(path)
    prefix = root.rstrip("/") + "/"
    rest = F.substring(path, len(prefix) + 1, 1 << 30)
    return F.coalesce(path.startswith(prefix), F.lit(False)) & path_is_safe(rest)


def human_size(n: Column | str) -> Column:
    """Bytes as ``512 B``, ``1.5 KB``, ``12 MB``: one decimal below ten, none above.

    Works on whole numbers (tenths of the unit, rounded half up) so that every engine agrees.
    """
    n = _col(n).cast("bigint")
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    units = ("KB", "MB", "GB", "TB")
    for power, unit in enumerate(units, start=1):
        size = 1 << (10 * power)
        small = F.least(n, F.lit(10 * size))
        tenths = F.shiftright(small * 10 + size // 2, 10 * power)
        short = F.format_string("%.1f", tenths / 10)
        text = F.when(n < 10 * size, short).otherwise(F.shiftright(n + size // 2, 10 * power).cast("string"))
        text = F.concat(text, F.lit(f" {unit}"))
        last = power == len(units)
        out = out.otherwise(text) if last else out.when(n < size * 1024, text)
    return out


def rfc3339(ts: Column | str) -> Column:
    """UTC text of a timestamp, whole seconds. The session time zone must be UTC."""
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def now_rfc3339() -> Column:
    return rfc3339(F.current_timestamp())


def verdict(
    sha_equal: Column | str, pixel_equal: Column | str, dims_equal: Column | str, ssim: Column | str
) -> Column:
    """One word for a compared pair; the first rule that holds wins."""
    score = F.coalesce(_col(ssim), F.lit(0.0))
    return (
        F.when(_col(sha_equal), "identical")
        .when(_col(pixel_equal), "same_pixels")
        .when(~_col(dims_equal), "incomparable")
        .when(score >= 0.995, "near_identical")
        .when(score >= 0.9, "similar")
        .otherwise("different")
    )
