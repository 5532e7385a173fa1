"""The approximate token count of the chunker (``approximate_v1``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what counts as one approximate token, in Java's syntax. A CJK character, an
# identifier run with inner - . / : joints, or any other character that isn't white space.
TOKEN_RE = r"(?U)[㐀-䶿一-鿿豈-﫿]|[A-Za-z0-9_]+(?:[-./:][A-Za-z0-9_]+)*|[^\s\x1c-\x1f]"
TOKEN_METHOD = "approximate_v1"


def token_count(text: Column) -> Column:
    """Approximate tokens of ``text`` as a bigint; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN_RE)), F.lit(0)).cast("bigint")
