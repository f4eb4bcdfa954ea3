"""Path and conflict-name expressions (F4, F5, F6, S8, S9): pure column expressions.

Stem/extension follow ``std::filesystem`` rules on the last path element:
``.bashrc`` has no extension, ``a.tar.gz`` is ``a.tar`` + ``gz``, ``dot.``
is ``dot`` + ``""``, and ``.``/``..`` are whole stems.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# stem/extension split and the conflicted-copy name layout.
STEM_EXT = r"^(.+)[.]([^.]*)$"
CONFLICT_TS_FORMAT = "yyyy-MM-dd HH-mm-ss"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def file_name(path) -> Column:
    return F.regexp_extract(_c(path), r"([^/]*)$", 1)


def parent_path(path) -> Column:
    return F.regexp_extract(_c(path), r"^(.*)/[^/]*$", 1)


def _splittable(name: Column) -> Column:
    return name.rlike(STEM_EXT) & ~name.isin(".", "..")


def extension(path) -> Column:
    """extension without the dot, ``""`` if none."""
    name = file_name(path)
    return F.when(_splittable(name), F.regexp_extract(name, STEM_EXT, 2)).otherwise(F.lit(""))


def stem(path) -> Column:
    """file name without its extension."""
    name = file_name(path)
    return F.when(_splittable(name), F.regexp_extract(name, STEM_EXT, 1)).otherwise(name)


def conflict_name(path, client_id, at_ts) -> Column:
    """``parent/stem (conflicted copy <client> YYYY-MM-DD HH-MM-SS)[.ext]``.

    ``at_ts`` is the resolution time: a TIMESTAMP is printed in the session
    zone (the reference prints local time); pass a TIMESTAMP_NTZ wall clock
    (``timeutil.utc_wall_clock``) for a zone-independent name.
    """
    p = _c(path)
    ext = extension(p)
    name = F.concat(
        stem(p),
        F.lit(" (conflicted copy "),
        _c(client_id),
        F.lit(" "),
        F.date_format(_c(at_ts), CONFLICT_TS_FORMAT),
        F.lit(")"),
        F.when(ext != "", F.concat(F.lit("."), ext)).otherwise(F.lit("")),
    )
    return F.when(p.contains("/"), F.concat(parent_path(p), F.lit("/"), name)).otherwise(name)


def hash_prefix(hash_col) -> Column:
    """First two hex characters, the chunk store's partition key."""
    return F.substring(_c(hash_col), 1, 2)


def chunk_address(hash_col, root: str = "") -> Column:
    """``root/chunks/<prefix>/<hash>``."""
    h = _c(hash_col)
    return F.concat(F.lit(f"{root}/chunks/" if root else "chunks/"), hash_prefix(h), F.lit("/"), h)


def client_path(client_id, path, root: str = "") -> Column:
    """``root/clients/<id>/<path>`` (target of a finalised upload)."""
    return F.concat(F.lit(f"{root}/clients/" if root else "clients/"), _c(client_id), F.lit("/"), _c(path))
