"""Column functions over category tokens such as <ORI_COLE1>."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token categories and their order in a prompt, and the separators of prompt and sequence.
HARD_PREFIXES = ("AMR", "ORI", "PROM", "REPORTER", "REP", "TAG", "ELEM")
CATEGORY_ORDER = ("VEC", "SP", "COPY", "BB", "AMR", "ORI", "PROM", "ELEM", "REPORTER", "TAG")
UNKNOWN_ORDER = 99
BOS, SEQ, EOS = "<BOS>", "<SEQ>", "<EOS>"
SEPARATORS = "<SEQ>|<SEP>"
# Length buckets, as upper limits with their labels.
LENGTH_BUCKETS = ((4096, "leq_4k"), (8192, "leq_8k"), (16384, "leq_16k"), (32768, "leq_32k"))
# Keywords of vector types and the token of each, and splits with the tokens that select them.
VECTOR_KEYWORDS = (("mammalian", "<VEC_MAMMALIAN>"), ("bacterial", "<VEC_BACTERIAL>"), ("lentivir", "<VEC_LENTIVIRAL>"), ("retrovir", "<VEC_RETROVIRAL>"), ("aav", "<VEC_AAV>"), ("crispr", "<VEC_CRISPR>"), ("yeast", "<VEC_YEAST>"), ("insect", "<VEC_INSECT>"), ("plant", "<VEC_PLANT>"))
SPLITS = (("bacterial", ("<VEC_BACTERIAL>",)), ("mammalian", ("<VEC_MAMMALIAN>", "<VEC_LENTIVIRAL>", "<VEC_RETROVIRAL>", "<VEC_AAV>")), ("crispr", ("<VEC_CRISPR>",)), ("yeast", ("<VEC_YEAST>",)), ("insect", ("<VEC_INSECT>",)), ("plant", ("<VEC_PLANT>",)))


def tokens_in(text: Column) -> Column:
    """All <...> tokens of a text, in order, with repeats."""
    return F.regexp_extract_all(text, F.lit("<[^>]+>"), F.lit(0))


def category_of(token: Column) -> Column:
    """What stands before the first underscore, without angle brackets."""
    return F.split_part(F.translate(token, "<>", ""), F.lit("_"), F.lit(1))


def hard_tokens(tokens: Column, prefixes: Iterable[str] = HARD_PREFIXES, exclude: Iterable[str] = ()) -> Column:
    """Tokens of the hard categories, order and repeats kept."""
    pattern = "^<(" + "|".join(prefixes) + ")_"
    return F.filter(tokens, lambda t: t.rlike(pattern) & ~t.isin(*exclude) if exclude else t.rlike(pattern))


def category_rank(token: Column, order: tuple[str, ...] = CATEGORY_ORDER) -> Column:
    """The category's place in the order, from 1; UNKNOWN_ORDER for others. The category is worked out once."""
    place = F.array_position(F.array(*[F.lit(name) for name in order]), category_of(token))
    return F.coalesce(F.nullif(place, F.lit(0)), F.lit(UNKNOWN_ORDER)).cast("int")


def canonical(tokens: Column, order: tuple[str, ...] = CATEGORY_ORDER) -> Column:
    """Tokens by category order, then by name."""
    return F.transform(F.array_sort(F.transform(tokens, lambda t: F.struct(category_rank(t, order).alias("o"), t.alias("t")))), lambda x: x["t"])


def prompt_of(tokens: Column) -> Column:
    return F.concat(F.lit(BOS), F.array_join(tokens, ""), F.lit(SEQ))


def length_bucket(n: Column) -> Column:
    out = F.lit("gt_32k")
    for top, label in reversed(LENGTH_BUCKETS):
        out = F.when(n <= top, label).otherwise(out)
    return out


def bucket_ordinal(label: Column) -> Column:
    """Number of a bucket label, so that "up to" compares sizes and not strings."""
    return F.element_at(F.create_map(*[x for i, (_, name) in enumerate((*LENGTH_BUCKETS, (0, "gt_32k"))) for x in (F.lit(name), F.lit(i))]), label)


def keyword_tokens(text: Column, keywords: Iterable[tuple[str, str]] = VECTOR_KEYWORDS) -> Column:
    """Sorted distinct tokens whose keyword occurs in the text, whatever the case."""
    low = F.lower(text)
    return F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.contains(low, F.lit(k)), F.lit(t)) for k, t in keywords]), lambda x: x.isNotNull())))


def clean_name(text: Column) -> Column:
    """Upper case; space, hyphen and slash become underscores; round brackets and dots go."""
    return F.translate(F.upper(text), " -/().", "___")


def copy_token(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(F.contains(low, F.lit("high")), "<COPY_HIGH>").when(F.contains(low, F.lit("low")), "<COPY_LOW>")


def split_labels(tokens: Column) -> Column:
    """combined, and every split that one of the tokens selects."""
    marks = [F.when(F.arrays_overlap(tokens, F.array(*[F.lit(x) for x in names])), F.lit(label)) for label, names in SPLITS]
    return F.filter(F.array(F.lit("combined"), *marks), lambda x: x.isNotNull())


def format_prompt(text: Column) -> Column:
    """Trimmed, with <BOS> and a space before it and a space and <SEQ> behind it, unless they are there."""
    t = F.trim(text)
    t = F.when(t.startswith(BOS), t).otherwise(F.concat(F.lit(BOS + " "), t))
    return F.when(t.endswith(SEQ), t).otherwise(F.concat(F.rtrim(t), F.lit(" " + SEQ)))


def validated(tokens: Column, known: Callable[[Column], Column], order: tuple[str, ...] = CATEGORY_ORDER) -> tuple[Column, Column]:
    """A prompt of the known tokens (once each, in canonical order) and the list of all others in the order seen."""
    good = canonical(F.array_distinct(F.filter(tokens, known)), order)
    return F.concat(F.lit(BOS + " "), F.array_join(good, " "), F.lit(" " + SEQ)), F.filter(tokens, lambda t: ~known(t))
