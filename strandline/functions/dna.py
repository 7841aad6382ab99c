"""Column functions over nucleotide sequences; all run inside the JVM."""

from __future__ import annotations

import hashlib
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the standard genetic code, codons in TCAG order.
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def clean_dna(text: Column) -> Column:
    """Upper case, without <...> tokens, only A, T, G, C and N."""
    return F.regexp_replace(F.regexp_replace(F.upper(text), "<[^>]+>", ""), "[^ATGCN]", "")


def clean_iupac(text: Column) -> Column:
    """Without FASTA header lines, upper case, only IUPAC codes."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.startswith(">"))
    return F.regexp_replace(F.upper(F.array_join(lines, "")), "[^ATGCNRYSWKMBDHV]", "")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTN", "TGCAN"))


def translate(seq: Column, frame: int = 0, stop: str = "*") -> Column:
    """Amino acids from a frame on; codons with other letters are X; null below three bases."""
    codons = F.regexp_extract_all(F.substr(seq, F.lit(frame + 1)), F.lit("(?s).{3}"), F.lit(0))
    place = lambda c: F.conv(F.translate(c, "TCAG", "0123"), 4, 10).cast("int") + 1
    one = lambda c: F.when(c.rlike("^[TCAG]{3}$"), F.substr(F.lit(AMINO.replace("*", stop)), place(c), F.lit(1))).otherwise("X")
    return F.when(F.length(seq) >= frame + 3, F.array_join(F.transform(codons, one), ""))


def back_translate(protein: Column) -> Column:
    """Bases that translate to a protein: of each amino acid's codons the last in the order TCAG; other letters become NNN."""
    codon = {a: "TCAG"[i // 16] + "TCAG"[i // 4 % 4] + "TCAG"[i % 4] for i, a in enumerate(AMINO)}
    table = F.create_map(*[F.lit(x) for pair in codon.items() for x in pair])
    return F.array_join(F.transform(F.split(protein, ""), lambda a: F.when(a == "", "").otherwise(F.coalesce(F.try_element_at(table, a), F.lit("NNN")))), "")


def six_frames(seq: Column, stop: str = "X") -> Column:
    """Frames f0, r0, f1, r1, f2, r2."""
    back = reverse_complement(seq)
    return F.array(*[translate(s, k, stop) for k in range(3) for s in (seq, back)])


def kmers(seq: Column, k: int) -> Column:
    """Distinct k-mers; none if the sequence is shorter."""
    return F.when(F.length(seq) >= k, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(seq) - k + 1, F.lit(1))), lambda i: F.substr(seq, i, F.lit(k))))).otherwise(F.array().cast("array<string>"))


def kmerize(seq: Column, k: int, stride: int) -> Column:
    """Windows every stride bases; a last one padded with A reaches the end.

    The padded sequence is cut into runs of stride bases once, and a window is put
    together from the runs that it spans, so the work is linear in the length.
    """
    n = F.greatest(F.ceil((F.length(seq) - k) / stride), F.lit(0)).cast("int") + 1
    runs = -(-k // stride)
    padded = F.rpad(seq, (n + runs - 1) * stride, "A")
    cut = F.array(F.regexp_extract_all(padded, F.lit(f"(?s).{{{stride}}}"), F.lit(0)))  # bound once, not by window
    window = lambda x, i: F.substr(F.concat(*[F.get(x, i + j) for j in range(runs)]), F.lit(1), F.lit(k))
    parts = F.flatten(F.transform(cut, lambda x: F.transform(F.sequence(F.lit(0), F.size(x) - runs), lambda i: window(x, i))))
    return F.when(F.length(seq) > 0, parts).otherwise(F.array().cast("array<string>"))


def kmer_decode(parts: Column, stride: int) -> Column:
    """The first stride letters of each k-mer, all of the last."""
    n = F.size(parts)
    return F.when(n > 0, F.concat(F.array_join(F.transform(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda x: F.substr(x, F.lit(1), F.lit(stride))), ""), F.try_element_at(parts, F.lit(-1)))).otherwise("")


#: Positions whose base for N is looked up in a constant; those beyond are worked out.
KNOWN_FILLS = 1 << 14


@lru_cache(maxsize=1)
def _fills() -> str:
    return "".join("ACGT"[int(hashlib.md5(str(i).encode()).hexdigest()[-1], 16) % 4] for i in range(KNOWN_FILLS))


def fill_n(seq: Column) -> Column:
    """Each N becomes ACGT[md5(position) mod 4]; only the last hex digit matters."""
    chars, known = F.split(seq, ""), F.split(F.lit(_fills()), "")  # the latter is folded into one constant
    pick = lambda i: F.substr(F.lit("ACGT"), (F.conv(F.right(F.md5(i.cast("string").cast("binary")), F.lit(1)), 16, 10).cast("int") % 4 + 1), F.lit(1))
    fill = lambda i: F.when(i < KNOWN_FILLS, F.get(known, i)).otherwise(pick(i))
    filled = F.array_join(F.transform(chars, lambda c, i: F.when(c == "N", fill(i)).otherwise(c)), "")
    return F.when(F.contains(seq, F.lit("N")), filled).otherwise(seq)


def tokenize_characters(text: Column) -> Column:
    """Special tokens as they are, and every other character but space as a token of its own."""
    return F.regexp_extract_all(text, F.lit(r"(?U)<[^>]+>|\S"), F.lit(0))


def kmer_id(token: Column, specials: tuple[str, ...], k: int, unknown: str) -> Column:
    """A token's id in kmer_vocabulary, from its letters as digits of base 4; that of unknown for all others."""
    kmer = F.when(token.rlike(f"^[ACGT]{{{k}}}$"), F.conv(F.translate(token, "ACGT", "0123"), 4, 10).cast("long") + len(specials))
    known = F.array_position(F.array(*[F.lit(s) for s in specials]), token)
    return F.coalesce(kmer, F.nullif(known, F.lit(0)) - 1, F.lit(specials.index(unknown))).cast("long")


def uuid5(namespace: str, name: Column) -> Column:
    """UUID version 5 of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(uuid.UUID(namespace).hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def fasta_id(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9_.-]", "_")


def encode_sample(prompt: Column, completion: Column, length: int, eos: int, pad: int) -> tuple[Column, Column, Column]:
    """input_ids, attention_mask and labels of fixed length; prompt and padding have the label -100."""
    ids = F.slice(F.concat(prompt, completion, F.array(F.lit(eos))), 1, length)
    n, m = F.size(ids), F.least(F.size(prompt), F.lit(length))
    fill = F.lit(length) - n
    inputs = F.concat(ids, F.array_repeat(F.lit(pad), fill))
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), fill))
    labels = F.concat(F.array_repeat(F.lit(-100), m), F.slice(ids, m + 1, F.greatest(n - m, F.lit(0))), F.array_repeat(F.lit(-100), fill))
    return inputs, mask, labels


def kmer_vocabulary(spark: SparkSession, specials: tuple[str, ...], k: int) -> DataFrame:
    """id and token: the special tokens, then all k-mers in the order of ACGT."""
    digit = lambda p: F.substr(F.lit("ACGT"), (F.floor(F.col("id") / 4 ** (k - 1 - p)) % 4 + 1).cast("int"), F.lit(1))
    bases = spark.range(4**k).select((F.col("id") + len(specials)).alias("id"), F.concat(*[digit(p) for p in range(k)]).alias("token"))
    return spark.createDataFrame(list(enumerate(specials)), "id long, token string").unionByName(bases)


def tokenize(text: Column, k: int, stride: int) -> Column:
    """Special tokens as they are; what stands between them, without space, in upper case and with N filled in, as k-mers."""
    parts = F.regexp_extract_all(text, F.lit("<[^>]+>|[^<]+|<"), F.lit(0))
    bases = lambda p: fill_n(F.upper(F.regexp_replace(p, r"\s+", "")))
    return F.flatten(F.transform(parts, lambda p: F.when(p.rlike("^<[^>]+>$"), F.array(p)).otherwise(F.flatten(F.transform(F.array(bases(p)), lambda s: kmerize(s, k, stride))))))


def detokenize(parts: Column, stride: int) -> Column:
    """Special tokens stay; of each run of k-mers the first letters, and all of the last."""
    special = lambda t: t.startswith("<") & t.endswith(">")
    last = lambda i: F.coalesce(special(F.try_element_at(parts, i + 2)), F.lit(True))  # noqa: E731  the next is special, or there is none
    return F.array_join(F.transform(parts, lambda t, i: F.when(special(t) | last(i), t).otherwise(F.substr(t, F.lit(1), F.lit(stride)))), "")


def frame_to_dna(start: Column, end: Column, offset: Column, reverse: Column, length: Column) -> tuple[Column, Column]:
    """First and last base of amino acids start to end of a frame; frames of the other strand are counted from its end."""
    low, high = start * 3 + offset, (end + 1) * 3 - 1 + offset
    return F.when(reverse, length - 1 - high).otherwise(low), F.when(reverse, length - 1 - low).otherwise(high)


def cigar(text: Column) -> Column:
    """matches, mismatches, ins, dels, start_query, end_query of a CIGAR string; insertions at either end only move the start."""
    core = F.regexp_replace(F.regexp_replace(text, "^(?:[0-9]+I)+", ""), "(?:[0-9]+I)+$", "")
    total = lambda s, ops: F.aggregate(F.transform(F.regexp_extract_all(s, F.lit(f"([0-9]+)[{ops}]"), F.lit(1)), lambda x: x.cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    lead = total(F.regexp_extract(text, "^((?:[0-9]+I)*)", 1), "I")
    aligned = total(core, "=MX")
    before = total(F.regexp_extract(core, "^((?:[0-9]+[ID])*)", 1), "I")
    after = total(F.regexp_extract(core, "((?:[0-9]+[ID])*)$", 1), "I")
    whole = lead + aligned + total(core, "I")
    none = aligned == 0
    return F.struct(total(core, "=M").alias("matches"), total(core, "X").alias("mismatches"), total(core, "I").alias("ins"), total(core, "D").alias("dels"), F.when(none, 0).otherwise(lead + before).alias("start_query"), F.when(none, 0).otherwise(whole - after - 1).alias("end_query"))


def splice(df: DataFrame, seq: str, repairs: str) -> DataFrame:
    """df with repaired and n_repairs: the repairs (start, end, motif; from the right) put into seq, without those that reach into one already done."""
    start = F.struct(F.col(seq).alias("s"), F.length(seq).alias("edge"), F.lit(0).alias("n"))
    done = lambda acc, r: F.when(r["end"] > acc["edge"], acc).otherwise(
        F.struct(F.concat(F.substr(acc["s"], F.lit(1), r["start"]), r["motif"], F.substr(acc["s"], r["end"] + 1, F.length(acc["s"]))).alias("s"), r["start"].alias("edge"), (acc["n"] + 1).alias("n"))
    )
    return df.withColumn("x", F.aggregate(repairs, start, done)).withColumn("repaired", F.col("x.s")).withColumn("n_repairs", F.col("x.n")).drop("x")
