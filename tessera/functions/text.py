"""Column functions on strings: hashes, ids, paths, terms and formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
POINT_NAMESPACE = "f47ac10b58cc4372a5670e02b2c3d479"
PREVIEW_CHARS = 100
TERM_CAP, LEAST_TERM = 20, 3
STOP_WORDS = (
    "the a an of to and or for in on with how where what which is are do does we it that this from into used use "
    "when by be before them they their its not has have but all can will was were been"
).split()
COMMIT_STOP_WORDS = [
    *STOP_WORDS,
    *"add adds added update updates updated change changes changed make makes made fix fixes fixed".split(),
]


def sha256_text(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def uuid5(name: Column, namespace: str = POINT_NAMESPACE) -> Column:
    """Version 5 UUID of ``name`` in a namespace given as 32 hex digits."""
    if len(namespace) != 32 or int(namespace, 16) < 0:
        raise ValueError("a namespace has 32 hex digits")
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)))
    digits = F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant, F.substring(h, 19, 14))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digits, a, n) for a, n in cuts])


def segment_hash(path: Column, start: Column, end: Column, content: Column, start_char: Column | None = None) -> Column:
    """Identity of a chunk: place, length and the first PREVIEW_CHARS characters."""
    parts = [path, start.cast("string"), end.cast("string"), *([] if start_char is None else [start_char.cast("string")])]
    return sha256_text(F.concat_ws("-", *parts, F.length(content).cast("string"), F.substring(content, 1, PREVIEW_CHARS)))


def profile_key(provider: Column, model: Column, dimension: Column) -> Column:
    return F.concat_ws(":", provider, model, dimension.cast("string"))


def extension_of_name(path: Column) -> Column:
    """Lower-case extension of the last path segment; none for names that only begin with a dot."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]*)$", 1))


def extension_of_path(path: Column) -> Column:
    """Lower-case rest of the whole path from its last dot, whatever comes after it."""
    return F.lower(F.regexp_extract(path, r"(\.[^.]*)$", 1))


def normalized_extensions(values: Column) -> Column:
    """Trimmed, lower case, with a dot, each once; blanks go."""
    clean = F.filter(F.transform(values, lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return F.array_distinct(F.transform(clean, lambda x: F.when(F.startswith(x, F.lit(".")), x).otherwise(F.concat(F.lit("."), x))))


def path_segments(path: Column) -> Column:
    """Parts between slashes of either kind, without empty ones."""
    return F.filter(F.split(path, r"[\\/]+"), lambda x: x != "")


def slashed(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def normalized_prefix(prefix: str) -> list[str]:
    """Segments of a search prefix, with "." and ".." resolved; [] means no filter."""
    out: list[str] = []
    for part in prefix.replace("\\", "/").split("/"):
        if part == ".." and out:
            out.pop()
        elif part not in ("", ".", ".."):
            out.append(part)
    return out


def under_segments(path: Column, prefix: str) -> Column:
    """Whether a path lies in a folder, by whole segments: src doesn't hold src2/x."""
    parts = normalized_prefix(prefix)
    if not parts:
        return F.lit(True)
    whole = "/".join(parts)
    return (slashed(path) == whole) | F.startswith(slashed(path), F.lit(f"{whole}/"))


def under_string(path: Column, prefix: str) -> Column:
    """Whether a path begins with a string: src holds src2/x.  Reaches the Parquet scan."""
    parts = normalized_prefix(prefix)
    return F.startswith(path, F.lit("/".join(parts))) if parts else F.lit(True)


def query_terms(text: Column, stop_words=STOP_WORDS) -> Column:
    """Distinct lower-case terms of LEAST_TERM characters or more that aren't stop words."""
    parts = F.split(F.lower(text), "[^a-z0-9]+")
    return F.array_distinct(F.filter(parts, lambda t: (F.length(t) >= LEAST_TERM) & ~t.isin(stop_words)))


def content_words(text: Column) -> Column:
    """All words of a commit's subject that say something, repeats too."""
    parts = F.split(F.lower(text), "[^a-z0-9]+")
    return F.filter(parts, lambda t: (F.length(t) >= LEAST_TERM) & ~t.isin(COMMIT_STOP_WORDS))


def occurrences(text: Column, term: Column) -> Column:
    """How often a term is in a text, without overlaps, at most TERM_CAP."""
    n = (F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)
    return F.least(F.lit(TERM_CAP), n.cast("int"))


def format_points(n: Column) -> Column:
    """999, 12.3k, 1.2M; ? for nulls and negative numbers."""
    return (
        F.when(n.isNull() | (n < 0), F.lit("?"))
        .when(n < 1000, F.floor(n).cast("string"))
        .when(n < 1_000_000, F.concat(F.round(n / 1000, 1).cast("decimal(20,1)").cast("string"), F.lit("k")))
        .otherwise(F.concat(F.round(n / 1_000_000, 1).cast("decimal(20,1)").cast("string"), F.lit("M")))
    )


def mask_secret(value: Column) -> Column:
    """The first and last four characters of a secret; dots for one of up to eight."""
    hidden = F.repeat(F.lit("•"), 8)
    return F.when(F.length(value) <= 8, hidden).otherwise(F.concat(F.substring(value, 1, 4), F.lit("…"), F.substring(value, -4, 4)))


def to_finite(value: Column) -> Column:
    """A finite double, or null."""
    x = value.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def shortened(text: Column, max_tokens: int, chars_per_token: int = 4, safety: float = 0.95) -> Column:
    """A text cut to what a model takes: tokens are counted as four characters, less a margin."""
    return F.substring(text, 1, int(max_tokens * chars_per_token * safety))


def prefixed(text: Column, prefix: str, most: int = 32_768) -> Column:
    """A text with a query prefix, unless it has it or would grow beyond ``most`` characters."""
    keep = F.startswith(text, F.lit(prefix)) | (F.length(text) + len(prefix) > most)
    return F.when(keep, text).otherwise(F.concat(F.lit(prefix), text))


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def error_text(*shapes: Column, most: int = 400) -> Column:
    """The first message that isn't blank, cut to ``most`` characters."""
    return F.substring(F.coalesce(*[F.nullif(F.trim(s), F.lit("")) for s in shapes], F.lit("unknown error")), 1, most)
