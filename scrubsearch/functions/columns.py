"""Column -> Column building blocks.

All of them are Spark built-ins and higher-order functions evaluated inside
the JVM, row by row, with no shuffle. Span offsets are UTF-8 byte offsets:
``octet_length`` is O(1) and a binary ``substring`` starts in O(1), whereas a
character ``substr`` rescans the string from its start on every call. Every
detector matches ASCII only, so a span's byte length is its character length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubsearch.functions import fixed

PAIR = T.StructType([
    T.StructField("ph", T.StringType()),
    T.StructField("original", T.StringType()),
])
MAPPING = T.StructType([
    T.StructField("ph", T.StringType()),
    T.StructField("original", T.StringType()),
    T.StructField("entity", T.StringType()),
])


def _empty(dtype: T.DataType) -> Column:
    return F.array().cast(T.ArrayType(dtype))


# Lambdas below only read their own variables. A row value a lambda needs
# (the text, the id list, the lookup map) is handed in as a zipped array
# (``array_repeat`` shares one reference), never referenced from inside the
# lambda: Catalyst may inline an expensive producer at such a reference and
# then evaluate it once per element. For the same reason operators explode
# computed arrays with the ``_outer`` generators: a plain explode makes the
# optimizer infer ``size(array) > 0`` and push a second copy of the whole
# array expression below the projection.


def _rep(value: Column, like: Column) -> Column:
    return F.array_repeat(value, F.size(like))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def pieces(text: Column, pattern: str) -> Column:
    """Text between matches; always size(matches) + 1 pieces (limit -1)."""
    return F.split(text, pattern, -1)


def interleave(parts: Column, fills: Column) -> Column:
    """parts[0] fills[0] parts[1] ... fills[n-1] parts[n]."""
    z = F.arrays_zip(parts.alias("p"), fills.alias("f"))
    return F.array_join(F.transform(z, lambda x: F.concat(x["p"], F.coalesce(x["f"], F.lit("")))), "")


def replace_matches(text: Column, pattern: str, fn) -> Column:
    """Replace the i-th match m of ``pattern`` by fn(m, i) in one pass."""
    return interleave(pieces(text, pattern), F.transform(matches(text, pattern), fn))


def luhn_ok(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def may_match(text: Column, entity: str) -> Column:
    """Cheap necessary condition for a detector to match (see DETECTOR_GUARD)."""
    lit = fixed.DETECTOR_GUARD.get(entity)
    return F.contains(text, F.lit(lit)) if lit else text.rlike("[0-9]")


def placeholder(prefix: str, scope: str, i: Column) -> Column:
    return F.concat(F.lit(prefix + scope), i.cast("string"), F.lit("__"))


def mask_token(i: Column) -> Column:
    return F.concat(F.lit(fixed.MASK_OPEN), i.cast("string"), F.lit(fixed.MASK_CLOSE))


def mask_preserved(text: Column) -> tuple[Column, Column]:
    """A1: (masked text, preserved originals). The i-th occurrence becomes an
    internal mask token; every occurrence gets its own number."""
    ids = matches(text, fixed.PRESERVE)
    return replace_matches(text, fixed.PRESERVE, lambda m, i: mask_token(i)), ids


def unmask_preserved(text: Column, ids: Column) -> Column:
    """Put the preserved originals back, in one pass."""
    nums = matches(text, fixed.MASK_NUMBER, 1)
    z = F.arrays_zip(nums.alias("n"), _rep(ids, nums).alias("ids"))
    return interleave(pieces(text, fixed.MASK_NUMBER),
                      F.transform(z, lambda x: F.get(x["ids"], x["n"].cast("int"))))


def preserved_pairs(ids: Column, scope: str) -> Column:
    return F.transform(ids, lambda m, i: F.struct(
        placeholder(fixed.PRESERVE_PREFIX, scope, i).alias("ph"), m.alias("original")))


def _bytes_at(b: Column, start: Column, length: Column) -> Column:
    """UTF-8 text of ``length`` bytes from byte offset ``start`` (0-based)."""
    return F.decode(F.substring(b, start + 1, length), "UTF-8")


def cut_spans(text: Column, merged: Column, fill) -> tuple[Column, Column]:
    """Replace each merged span by fill(span, i); returns (text, originals)."""
    b = F.encode(text, "UTF-8")
    ends = F.transform(merged, lambda x: x["e"])
    prev = F.slice(F.concat(F.array(F.lit(0)), ends), 1, F.size(ends))
    z = F.arrays_zip(merged.alias("x"), prev.alias("pe"), _rep(b, merged).alias("b"))
    body = F.array_join(F.transform(z, lambda y, i: F.concat(
        _bytes_at(y["b"], y["pe"], y["x"]["s"] - y["pe"]), fill(y["x"], i))), "")
    last_e = F.coalesce(F.array_max(ends), F.lit(0))
    out = F.concat(body, _bytes_at(b, last_e, F.octet_length(text) - last_e))
    originals = F.transform(z, lambda y: _bytes_at(y["b"], y["x"]["s"], y["x"]["e"] - y["x"]["s"]))
    return out, originals


def char_offset(text: Column, byte_offset: Column) -> Column:
    """Character offset of a byte offset (for reports only; O(offset))."""
    return F.length(_bytes_at(F.encode(text, "UTF-8"), F.lit(0), byte_offset))


def title_case(s: Column) -> Column:
    """Python str.title() for ASCII: upper after a non-letter, lower after a letter."""
    chars = F.slice(F.split(s, "", -1), 1, F.length(s))
    prev = F.slice(F.concat(F.array(F.lit("")), chars), 1, F.size(chars))
    z = F.arrays_zip(chars.alias("c"), prev.alias("b"))
    return F.array_join(F.transform(z, lambda x: F.when(~x["b"].rlike("[A-Za-z]"), F.upper(x["c"]))
                                    .otherwise(F.lower(x["c"]))), "")


def restore(text: Column, pairs: Column) -> Column:
    """Map every placeholder in ``text`` to its original in one pass.

    One pass means a restored value is never scanned again, so an original
    that itself looks like a placeholder cannot be replaced a second time.
    Unknown placeholders stay as they are."""
    lookup = F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["ph"], p["original"])))
    ms = matches(text, fixed.PLACEHOLDER)
    z = F.arrays_zip(ms.alias("m"), _rep(lookup, ms).alias("lk"))
    return interleave(pieces(text, fixed.PLACEHOLDER),
                      F.transform(z, lambda x: F.coalesce(F.try_element_at(x["lk"], x["m"]), x["m"])))
