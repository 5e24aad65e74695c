"""Text functions as Column expressions: tokens, names, paths, ids, truncation, offsets, JavaScript-style rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"([\p{L}\p{N}_]+)"
PUNCTUATION = r"""[\s,./\\|\[\]{}()"':;!?<>`~@#$%^&*+=-]+"""


def bound(value: Column, of) -> Column:
    """of(value) with value computed once, however often and in whatever lambda `of` reads it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-cased words (letters, digits, underscore) in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))


def punctuation_tokens(text: Column, least: int = 1) -> Column:
    """Distinct lower-cased pieces between white space and punctuation, of at least `least` characters."""
    return F.array_distinct(F.filter(F.split(F.lower(text), PUNCTUATION), lambda t: F.length(t) >= least))


def js_round(x: Column, digits: int = 0) -> Column:
    """Rounds half toward positive infinity, as JavaScript's Math.round does."""
    f = float(10**digits)
    return F.floor(x * F.lit(f) + F.lit(0.5)) / F.lit(f)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^\./", "")


def path_tokens(path: Column) -> Column:
    """Lower-cased letters-and-digits parts of a path in order, cut at camel case too; repeats stay."""
    spaced = F.regexp_replace(path, "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda t: t != "")


def module_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(name)), r"[\s_]+", "-"), "-+", "-")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def project_id(path: Column) -> Column:
    return F.substring(F.md5(path), 1, 10)


def content_hash(text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the text without case and repeated white space."""
    return F.substring(F.sha2(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), 256), 1, 16)


def truncate_middle(text: Column, limit: int) -> Column:
    """Head and tail of a longer text around an ellipsis, `limit` characters in all."""
    head, tail = (limit - 3 + 1) // 2, (limit - 3) // 2
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, head), F.lit("..."), F.right(text, F.lit(tail))))


def truncate_head_tail(text: Column, limit: int, head_share: float) -> Column:
    head = int(limit * head_share)
    tail = limit - head - 5
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, head), F.lit("\n...\n"), F.right(text, F.lit(tail))))


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based character offset."""
    before = F.substr(text, F.lit(1), offset.cast("int"))
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def solid_length(text: Column) -> Column:
    """Characters other than space, tab and line breaks."""
    return F.length(F.regexp_replace(text, "[ \t\n\r]", ""))


def breadcrumb_parent(crumb: Column) -> Column:
    parts = F.split(crumb, " > ")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), " > ")).otherwise(crumb)


def identifier_variants(name: Column) -> Column:
    """Lower case, without separators, snake and camel form of a code identifier."""
    spaced = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2")
    snake = F.lower(F.regexp_replace(spaced, r"[./-]+", "_"))
    bare = F.regexp_replace(snake, "_", "")
    pieces = F.filter(F.split(snake, "_"), lambda p: p != "")
    camel = F.concat(F.element_at(pieces, 1), F.array_join(F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.initcap(p)), ""))
    return F.array_distinct(F.array_compact(F.array(F.lower(name), bare, snake, camel)))


def overlap_score(text: Column, terms: Column) -> Column:
    """Sum over distinct terms: 1 where the term stands alone in the text, 0.5 where it is only part of a word."""

    def of(both: Column) -> Column:
        low, words = both["low"], both["words"]

        def one(t: Column) -> Column:
            # A whole token stands alone where the text has that token; other terms are looked for with what is around them.
            alone = F.when(F.regexp_like(t, F.lit(r"^[\p{L}\p{N}_]+$")), F.array_contains(words, t)).otherwise(F.regexp_like(low, F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), t, F.lit(r"\E(?![\p{L}\p{N}_])"))))
            return F.when(~F.contains(low, t), 0.0).when(alone, 1.0).otherwise(0.5)

        return F.aggregate(terms, F.lit(0.0), lambda s, t: s + one(t))

    return bound(F.struct(F.lower(text).alias("low"), tokens(text).alias("words")), of)


def set_cosine(a: Column, b: Column) -> Column:
    size = F.sqrt((F.size(a) * F.size(b)).cast("double"))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / size)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(F.array_union(a, b)))


def pairs(text: Column) -> Column:
    """'k=v | k=v' as a map: pieces without '=' or key are left out, a value keeps its further '=', the last of a key wins."""
    pieces = F.filter(F.transform(F.split(text, r"\|"), lambda p: F.trim(p)), lambda p: F.instr(p, "=") > 1)
    both = F.transform(pieces, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("key"), F.trim(F.regexp_replace(p, "^[^=]*=", "")).alias("value")))
    return bound(both, lambda b: F.map_from_entries(F.filter(b, lambda x, i: ~F.exists(F.slice(b, i + 2, F.size(b)), lambda y: y["key"] == x["key"]))))


def base64url(text: Column) -> Column:
    """UTF-8 text in the URL alphabet of base64, without padding and line breaks."""
    return F.rtrim(F.translate(F.base64(F.encode(text, "UTF-8")), "+/\r\n", "-_"), F.lit("="))


def from_base64url(code: Column) -> Column:
    """Text of base64url; null where it isn't."""
    plain = F.translate(code, "-_", "+/")
    padded = F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4))))
    return F.decode(F.try_to_binary(padded, F.lit("base64")), "UTF-8")


#: Runs of one script: Han and kana are written without blanks between words.
_RUNS = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー]+|[\p{L}\p{N}_&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー]]+)"
_UNSPACED = r"^[\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー]"


def segments(text: Column) -> Column:
    """Lower-cased words in order; a run of Han or kana gives its characters and every two neighbours, so that a word inside a sentence is found.

    Other scripts give what `tokens` gives, cut where such a run begins or ends. A null text gives null.
    """
    runs = F.regexp_extract_all(F.lower(text), F.lit(_RUNS), F.lit(1))

    def parts(run: Column) -> Column:
        n = F.length(run)
        at = F.sequence(F.lit(1), n)
        grams = F.flatten(F.transform(at, lambda i: F.when(i < n, F.array(F.substr(run, i, F.lit(1)), F.substr(run, i, F.lit(2)))).otherwise(F.array(F.substr(run, i, F.lit(1))))))
        return F.when(F.regexp_like(run, F.lit(_UNSPACED)), grams).otherwise(F.array(run))

    return F.flatten(F.transform(runs, parts))


def query_segments(text: Column) -> Column:
    """Distinct segments of a query: of a Han or kana run, the neighbours in twos alone (or its one character)."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(_RUNS), F.lit(1))

    def parts(run: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substr(run, i, F.lit(2)))
        return F.when(F.regexp_like(run, F.lit(_UNSPACED)), grams).otherwise(F.array(run))

    return F.array_distinct(F.flatten(F.transform(runs, parts)))
