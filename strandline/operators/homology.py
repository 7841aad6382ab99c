"""Homology search as joins: protein seeds in all six frames, translated hits, subjects as tokens, and the best hit of both searches."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strandline.functions import dna
from strandline.functions.proteins import AMINO_ACIDS, protein_scores
from strandline.operators import align
from strandline.operators.order import checkpoint, spread

#: Letters of a seed, and the least score of a word against a protein's word for it to be its neighbour.
WORD, NEIGHBOUR = 4, 17
#: Seeds on diagonals of one band, and its width, that make a pair of protein and sequence worth aligning.
SEEDS, BAND = 2, 16
#: Rows of a seed index that are broadcast at most (some 40 bytes each); beyond, words are shuffled.
BROADCAST_SEEDS = 1_000_000
#: All words there can be; a word's code has a digit of base 20 for each letter.
WORDS = len(AMINO_ACIDS) ** WORD


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """The letters of all words, as places in AMINO_ACIDS."""
    return np.stack(np.unravel_index(np.arange(WORDS), (len(AMINO_ACIDS),) * WORD), axis=1).astype(np.int8)


def word_code(word: str) -> int | None:
    """A word's code; None if it isn't WORD amino acids."""
    at = [AMINO_ACIDS.find(c) for c in word]
    return None if len(at) != WORD or -1 in at else reduce(lambda x, y: x * len(AMINO_ACIDS) + y, at)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def neighbours(words: pd.Series) -> pd.Series:
    """Codes of the words that score NEIGHBOUR or more against each word (BLOSUM62), with its own; none for other letters."""
    letters = _letters()
    table = protein_scores()[np.ix_(*[np.frombuffer(AMINO_ACIDS.encode(), np.uint8)] * 2)].astype(np.int16)
    out = []
    for word in words:
        code = word_code(word) if word else None
        if code is None:
            out.append([])
            continue
        score = sum(table[AMINO_ACIDS.index(c)][letters[:, i]] for i, c in enumerate(word))
        out.append(sorted({code, *np.flatnonzero(score >= NEIGHBOUR).tolist()}))
    return pd.Series(out)


def seed_index(proteins: DataFrame, key: str = "sseqid", protein: str = "protein") -> DataFrame:
    """key, at (place in the protein) and word (a code), for every word near one of the protein's. Distinct words are looked up once."""
    own = proteins.where(F.length(protein) >= WORD).select(key, F.posexplode(F.regexp_extract_all(protein, F.lit(f"(?=(.{{{WORD}}}))"), F.lit(1))).alias("at", "own"))
    near = own.select("own").distinct().select("own", F.explode(neighbours("own")).alias("word"))
    return own.join(near, "own").select(key, "at", "word")


#: The place of a codon that holds other letters than TCAG, past all others.
_OTHER = 64
_FRAME_LETTERS = np.frombuffer((dna.AMINO + "X").encode(), np.uint8)
_PLACES = np.array([AMINO_ACIDS.find(c) for c in dna.AMINO + "X"], np.int8)


def _codons(seq: str) -> list[np.ndarray]:
    """The codons of the six frames (f0, r0, f1, r1, f2, r2) as places in the genetic code."""
    digit, back = np.full(256, _OTHER, np.int64), np.arange(256, dtype=np.uint8)
    digit[np.frombuffer(b"TCAG", np.uint8)] = range(4)
    back[np.frombuffer(b"ACGT", np.uint8)] = np.frombuffer(b"TGCA", np.uint8)
    bases = np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)
    out = []
    for k in range(3):
        for strand in (bases, back[bases[::-1]]):
            d = digit[strand[k:]]
            n = 3 * (len(d) // 3)
            out.append(np.minimum(16 * d[0:n:3] + 4 * d[1:n:3] + d[2:n:3], _OTHER))
    return out


def six_frames(seq: str) -> list[str]:
    """The proteins of the six frames, stops as *, as dna.six_frames has them."""
    return [_FRAME_LETTERS[x].tobytes().decode() for x in _codons(seq)]


@F.pandas_udf(T.StructType([T.StructField(c, T.IntegerType()) for c in ("score", "start", "end", "matches", "mismatches", "gaps", "frame")]))
def protein_hit(protein: pd.Series, sequence: pd.Series) -> pd.DataFrame:
    """align.protein_hits in the frames of a sequence; each distinct sequence of a batch is translated once."""
    frames = {s: six_frames(s) for s in sequence.dropna().unique()}
    rows = align.protein_hits(protein.fillna("").tolist(), [frames.get(s, []) for s in sequence])
    return pd.DataFrame(rows, columns=["score", "start", "end", "matches", "mismatches", "gaps", "frame"]).astype("int32")


def frame_words(sequences: DataFrame, known: DataFrame, key: str = "plasmid_id", sequence: str = "sequence") -> DataFrame:
    """key, frame, at and word (a code): where the six frames have one of the known words (a column word).

    Which words are known is sent to the tasks as one flag a word there can be, of
    which there are WORDS, so only words that meet something leave a task.
    """
    flags = np.zeros(WORDS, bool)
    flags[[r["word"] for r in known.select("word").distinct().collect()]] = True  # WORDS rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, frames, places, words = [], [], [], []
            for i, seq in enumerate(batch.column(1).to_pylist()):
                for frame, x in enumerate(_PLACES[c] for c in _codons(seq or "")):
                    n = len(x) - WORD + 1
                    if n < 1:
                        continue
                    code, whole = np.zeros(n, np.int64), np.ones(n, bool)
                    for j in range(WORD):
                        part = x[j : j + n]
                        code, whole = code * len(AMINO_ACIDS) + part, whole & (part >= 0)
                    at = np.flatnonzero(whole)
                    at = at[flags[code[at]]]
                    rows.append(np.full(len(at), i))
                    frames.append(np.full(len(at), frame, np.int32))
                    places.append(at.astype(np.int32))
                    words.append(code[at].astype(np.int32))
            if rows:
                picked = batch.column(0).take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([picked, *[pa.array(np.concatenate(x)) for x in (frames, places, words)]], [key, "frame", "at", "word"])

    picked = sequences.select(key, sequence)
    schema = T.StructType([picked.schema[key], *[T.StructField(c, T.IntegerType()) for c in ("frame", "at", "word")]])
    return picked.mapInArrow(run, schema)


def protein_candidates(proteins: DataFrame, sequences: DataFrame, key: str = "sseqid", target: str = "plasmid_id") -> DataFrame:
    """target, key: pairs with SEEDS seeds or more at different places on near diagonals of one frame.

    The index of the proteins' words, of which there are few, meets the frames'
    words in a join; a pair and band is a count, combined before it is shuffled.
    Bands overlap by half, so seeds half a band apart always share one.
    """
    index = checkpoint(seed_index(proteins, key).select(key, F.col("at").alias("__own"), "word"))
    index = F.broadcast(index) if index.count() <= BROADCAST_SEEDS else index
    met = frame_words(sequences, index, target).join(index, "word")
    band = F.floor((F.col("at") - F.col("__own")) / (BAND // 2))
    met = met.select(target, key, "frame", "__own", F.explode(F.array(band, band + 1)).alias("band")).distinct()
    return met.groupBy(target, key, "frame", "band").agg(F.count("*").alias("n")).where(F.col("n") >= SEEDS).select(target, key).distinct()


#: Motifs, and sequences, that meet in one step of a search by DNA.
MOTIF_BLOCK, SEQUENCE_BLOCK = 256, 32


def _blocks(df: DataFrame, name: str, key: str, seq: str, size: int) -> DataFrame:
    """name (a number) and rows: keys and sequences in blocks of some size."""
    n = max(1, -(-df.count() // size))
    return df.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).alias(name)).agg(F.collect_list(F.struct(F.col(key).alias("key"), F.col(seq).alias("seq"))).alias(f"{name}_rows"))


def _most(motif: str) -> int:
    """The score that no sequence exceeds: a single N, which equals nothing, costs least against a base, more of them as a gap."""
    return align.within_score(motif, re.sub("NN+", "", motif))[0]


def dna_pairs(motifs: DataFrame, sequences: DataFrame, least: float, key: str = "sseqid", motif: str = "motif", target: str = "plasmid_id", sequence: str = "sequence") -> DataFrame:
    """target, key and strand: where the whole motif, or its reverse complement, scores least or more by its letter within the sequence.

    Every motif is scored in every sequence, block by block, without seeds: at
    scores that are found, pairs need not share more than two letters in a row.
    Only motifs with so many N that nothing scores enough are left out.
    """
    motifs, sequences = motifs.where(F.length(motif) > 0).select(key, motif), sequences.where(F.length(sequence) > 0).select(target, sequence)
    met = spread(_blocks(sequences, "t", target, sequence, SEQUENCE_BLOCK).crossJoin(_blocks(motifs, "m", key, motif, MOTIF_BLOCK)), "t", "m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = str.maketrans("ACGT", "TGCA")
        number, keys, bar, scorer = None, [], np.zeros(0), None
        for batch in batches:
            blocks = batch.column("m").to_pylist()
            for i in np.argsort(blocks, kind="stable").tolist():
                if blocks[i] != number:
                    number, rows = blocks[i], batch.column("m_rows")[i].as_py()
                    rows = [r for r in rows if _most(r["seq"]) >= least * len(r["seq"])]
                    keys, seqs = [r["key"] for r in rows], [r["seq"] for r in rows]
                    scorer = align.Motifs([*seqs, *[x[::-1].translate(back) for x in seqs]]) if rows else None
                    bar = least * np.array([len(x) for x in seqs] * 2)
                if scorer is None:
                    continue
                rows = batch.column("t_rows")[i].as_py()
                distinct = {x: k for k, x in enumerate(dict.fromkeys(r["seq"] for r in rows))}
                found = scorer.scores(list(distinct)) >= bar
                at, of = np.nonzero(found[[distinct[r["seq"]] for r in rows]])
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for k in pick], f.type) for x, pick, f in (([r["key"] for r in rows], at, out[0]), (keys * 2, of, out[1]), ("+" * len(keys) + "-" * len(keys), of, out[2]))], schema=out)

    schema = T.StructType([sequences.schema[target], motifs.schema[key], T.StructField("strand", T.StringType())])
    out = to_arrow_schema(schema)
    return met.mapInArrow(run, schema)


def metrics(n: Column) -> list[Column]:
    """Of a hit h: norm_score (per letter of the n searched), pct_id and coverage."""
    matches, mismatches = F.col("h.matches"), F.col("h.mismatches")
    return [(F.col("h.score") / n).alias("norm_score"), (100 * matches / F.greatest(matches + mismatches, F.lit(1))).alias("pct_id"), (100 * matches / n).alias("coverage")]


def translated_hits(pairs: DataFrame, protein: str = "protein", sequence: str = "sequence") -> DataFrame:
    """pairs with the best place of the protein in the sequence's six frames: score, frame, start and end (in bases, end past the last) and metrics.

    Amino acid places become places in the DNA; those of reverse frames are
    mirrored. Pairs without protein or frames are left out.
    """
    columns = [c for c in pairs.columns if c not in (protein, sequence)]
    hit = pairs.withColumn("h", protein_hit(F.col(protein), F.col(sequence))).where("h.frame >= 0 and h.end > h.start")
    low, high = dna.frame_to_dna(F.col("h.start"), F.col("h.end") - 1, F.floor(F.col("h.frame") / 2), F.col("h.frame") % 2 == 1, F.length(sequence))
    return hit.select(*columns, "h.score", "h.frame", low.cast("int").alias("start"), (high + 1).cast("int").alias("end"), *metrics(F.length(protein)))


def resolve_subjects(hits: DataFrame, known: DataFrame, subject: str = "sseqid") -> DataFrame:
    """hits with token: the subject's last field between pipes is looked up as an id of known (sseqid, token), else as an id made safe for FASTA.

    Ids made safe that several ids share count as the smallest of these. Hits of unknown subjects are left out.
    """
    own = F.element_at(F.split(F.col(subject), r"\|"), -1)
    plain = known.groupBy(F.col("sseqid").cast("string").alias("__id")).agg(F.min("token").alias("__plain"))
    safe = known.groupBy(dna.fasta_id(F.col("sseqid").cast("string")).alias("__id")).agg(F.min_by("token", F.struct(F.col("sseqid").cast("string"), "token")).alias("__safe"))
    found = hits.withColumn("__id", own).join(plain, "__id", "left").join(safe, "__id", "left")
    return found.withColumn("token", F.coalesce("__plain", "__safe")).where("token is not null").drop("__id", "__plain", "__safe")


def token_hits(nucleotide: DataFrame, translated: DataFrame, known: DataFrame, min_coverage: float = 30.0, min_identity: float = 0.0, ties: Sequence[str] = ()) -> DataFrame:
    """qseqid, token and the best hit of both searches by bit score, with its places; of equals a nucleotide hit, then the first place, then the lowest in the columns ties.

    Hits have the columns of tabular search output. Coverage (100 at most) is of
    the subject, and norm_score is bits per letter of it. Without ties a hash of
    the subject decides between hits of one place.
    """
    both = nucleotide.withColumn("__order", F.lit(0)).unionByName(translated.withColumn("__order", F.lit(1)), allowMissingColumns=True)
    slen = F.greatest("slen", F.lit(1))
    both = both.withColumn("coverage", F.least(100 * F.col("length") / slen, F.lit(100.0))).where((F.col("coverage") >= min_coverage) & (F.col("pident") >= min_identity))
    rows = resolve_subjects(both, known)
    rank = F.struct(F.isnull("bitscore").alias("b"), (-F.col("bitscore")).alias("s"), "__order", F.least("qstart", "qend").alias("q"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(ties)], F.xxhash64("sseqid").alias("h"))
    hit = F.struct("sseqid", "bitscore", "evalue", F.least("pident", F.lit(100.0)).alias("pct_id"), "coverage", (F.col("bitscore") / slen).alias("norm_score"), F.least("qstart", "qend").alias("lo"), F.greatest("qstart", "qend").alias("hi"), F.when(F.col("__order") == 0, "nucleotide").otherwise("translated").alias("search"))
    return rows.groupBy("qseqid", "token").agg(F.min_by(hit, rank).alias("x")).select("qseqid", "token", "x.*")
