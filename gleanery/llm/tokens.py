"""Token ids of whole texts, and the exact length histogram that answers token counts for every context limit.

Ids are those of the ``tokenizers`` library for a byte-level BPE vocabulary file (an added token in a text gets its own id). The file is
compiled once by each worker into the ranks that ``tiktoken`` reads, whose matcher gives the same ids in a fifth of the time and keeps
nothing from one text to the next; a vocabulary that isn't of that form, and a text with a run of blanks too long for that matcher, go
to ``tokenizers`` itself.

Defined results: a null or empty text has no ids; repeated rows count each; very long texts are encoded whole, a few MB of texts at a
time; equal lengths are one row of the histogram; an empty table gives no row. Only the named text column is read, so other columns may
have any name.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, in_slices, read, written

VOCABULARY = "byte_bpe_50k.json"
#: Fixed value: how a byte-level pre-tokenizer cuts a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of white space that tiktoken's matcher may not get through.
LONG_BLANKS = re.compile(r"\s{2000}")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_of() -> dict[str, int]:
    """The byte for each character of a byte-level vocabulary: visible Latin-1 stands for itself, other bytes for 256 and up, in order."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def ranks(spec: dict) -> dict[bytes, int] | None:
    """Bytes of each token to its id, if ids follow the merges; None for a file of another kind."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec.get("normalizer"):
        return None
    if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in spec["added_tokens"]):
        return None
    added, byte = {a["content"] for a in spec["added_tokens"]}, byte_of()
    vocab = {t: i for t, i in model["vocab"].items() if t not in added}
    made = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if None in made or made != sorted(made) or any(c not in byte for t in vocab for c in t):
        return None
    return {bytes(byte[c] for c in t): i for t, i in vocab.items()}


class Encoder:
    """Texts to ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self._library, self.fast = path, None, None
        if found := ranks(spec):
            import tiktoken

            self.fast = tiktoken.Encoding(
                path, pat_str=PATTERN, mergeable_ranks=found, special_tokens={a["content"]: a["id"] for a in spec["added_tokens"]}
            )

    @property
    def library(self):  # noqa: ANN201  tokenizers is imported only where it is needed
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if self.fast is None or (len(text) >= 2000 and LONG_BLANKS.search(text)):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_lengths(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(n_tokens) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for part in in_slices(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array((len(encode(t)) for t in part.column(0).to_pylist()), pa.int64())], ["n_tokens"])

    return docs.select(F.col(text).alias("text")).transform(bounded).mapInArrow(run, "n_tokens long")


def length_histogram(docs: DataFrame, path: str, text: str = "text", block: int = 1024) -> DataFrame:
    """One row per distinct encoded length L, taken as the context limit.

    n_docs: texts of exactly L tokens; n_up_to and n_longer: of at most and of more than L; quantile: n_up_to as a share of all;
    tokens_up_to: the tokens of those of at most L; truncated_tokens: what remains of all tokens when each text is cut at L;
    total_tokens: without a limit. The first L with quantile >= q is the q-quantile; a limit between two rows reads off the lower
    one, plus (limit - L) tokens for each of its n_longer texts.

    Sums over greater lengths come from two levels: totals of blocks of ``block`` lengths, then lengths inside a block, so no task
    sees more than a block's lengths or one row per block. A null text counts as empty (0 tokens); an empty table gives no row.
    """
    lengths = token_lengths(docs, path, text).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
    lengths = written(lengths.withColumn("block", F.floor(F.col("n_tokens") / block)), "lengths")
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = lengths.groupBy("block").agg(F.sum("n_docs").alias("n"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    blocks = blocks.select(
        "block", *(F.coalesce(F.sum(x).over(after), F.lit(0)).alias(f"{x}_after") for x in "nt"),
        *(F.sum(x).over(every).alias(f"{x}_all") for x in "nt")
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    rows = lengths.join(blocks, "block").withColumn("n_longer", F.col("n_after") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0)))
    rows = rows.withColumn("t_longer", F.col("t_after") + F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside), F.lit(0)))
    up_to = F.col("t_all") - F.col("t_longer")
    return rows.select(
        F.col("n_tokens").alias("context_limit"), "n_docs", (F.col("n_all") - F.col("n_longer")).alias("n_up_to"), "n_longer",
        ((F.col("n_all") - F.col("n_longer")) / F.col("n_all")).alias("quantile"), up_to.alias("tokens_up_to"),
        (up_to + F.col("n_longer") * F.col("n_tokens")).alias("truncated_tokens"), F.col("t_all").alias("total_tokens"),
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(read(spark, sf_dir, "documents"), vocabulary_path())
