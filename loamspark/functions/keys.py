"""Keys and fingerprints that any engine derives alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the namespace of URLs in RFC 4122.
NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def name_uuid(*parts: Column) -> Column:
    """The name-based UUID (version 5) of parts joined by NUL; null where a part is."""
    name = parts[0]
    for part in parts[1:]:
        name = F.concat(name, F.lit("\0"), part)
    digest = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))


def fingerprint(ids: Column, *versions: str) -> Column:
    """SHA-256 of the sorted ids (null counts as empty) and versions, joined by U+0001."""
    known = F.array_sort(F.transform(ids, lambda x: F.coalesce(x, F.lit(""))))
    return F.sha2(F.array_join(F.concat(known, F.array(*[F.lit(v) for v in versions])), "\u0001"), 256)
