"""Text functions whose results equal those of the usual Python ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points that Unicode-aware stripping removes.
SPACE = "".join(map(chr, (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)))


def strip(c: Column) -> Column:
    """White space of all kinds off both ends; null is empty."""
    return F.btrim(F.coalesce(c, F.lit("")), F.lit(SPACE))


def prompt_key(first_user: Column) -> Column:
    """Group key of a conversation: from its first user message, as it is; none counts as empty."""
    return F.substring(F.sha1(F.coalesce(first_user, F.lit("")).cast("binary")), 1, 16)


def seeded(seed: int | str, *parts: Column | str) -> Column:
    """A reproducible order: any engine with MD5 gives the same."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts)).cast("binary"))
