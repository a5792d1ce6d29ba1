"""Chat formatting by token-level assembly.

Every segment (role name where it is not a known one, text) is encoded on its
own; reserved ids beyond the vocabulary are spliced between the segments, so no
text can ever produce a marker id. The loss mask comes from a prefix sum over
segment lengths. In the rendered string the markers are control strings; the
same strings inside a text get a backslash in front, and so does a backslash,
which makes the escape reversible.

One turn is one row from scan to result: a conversation of any length is never
gathered into one value. `token_offset` tells where a turn's ids start in its
conversation. Defined cases: null text or role is empty; a null conv_id is a
conversation of its own; turns order by (turn, role, text), nulls first, and
repeated rows all stay; an empty table gives an empty result; further columns of
the input are dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read_table, tokenizer_file


@dataclass(frozen=True)
class Template:
    """Markers of the rendered string, and the reserved ids that stand for them."""

    vocabulary: int = 50_257
    roles: tuple[str, ...] = ("system", "user", "assistant")
    loss_role: str = "assistant"
    head: str = "### "
    after_role: str = ": "
    end: str = " </turn>\n"
    control: tuple[str, ...] = ("###", "</turn>")

    @property
    def other(self) -> int:
        return self.vocabulary + len(self.roles)

    @property
    def role_end(self) -> int:
        return self.other + 1

    @property
    def turn_end(self) -> int:
        return self.other + 2

    def escape(self, text: str) -> str:
        return re.sub("(" + "|".join(map(re.escape, ("\\", *self.control))) + ")", r"\\\1", text)

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(" + "|".join(map(re.escape, ("\\", *self.control))) + ")", r"\1", text)

    def opening(self, marker: int, role: str) -> str:
        """Rendered start of a turn; a role outside `roles` is marked with @, so that User and user stay apart."""
        return self.head + (f"@{self.escape(role)}" if marker == self.other else self.roles[marker - self.vocabulary].capitalize()) + self.after_role


def load_encoding(ranks_file: str, special: bool = False):
    """The byte-level BPE of a public ranks file."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)} if special else {})


def assemble(encode, template: Template, role: str, text: str) -> tuple[list[int], list[int]]:
    """Ids and loss mask of one turn."""
    known = role in template.roles
    segments = [
        ([template.vocabulary + template.roles.index(role)] if known else [template.other, *encode(template.escape(role)), template.role_end], 0),
        (encode(template.escape(text)), int(role == template.loss_role)),
        ([template.turn_end], 0),
    ]
    ids = [i for part, _ in segments for i in part]
    # +1 where a trained segment starts, -1 where it ends: the prefix sum is the mask
    steps = np.zeros(len(ids) + 1, dtype=np.int64)
    at = 0
    for part, trained in segments:
        steps[at] += trained
        at += len(part)
        steps[at] -= trained
    return ids, np.cumsum(steps)[: len(ids)].tolist()


def read_back(decode, template: Template, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str, str]:
    """Role, text, text under the loss mask, and rendered string of one turn, from ids and mask alone."""
    marker = int(ids[0])
    text_at = 1
    role = template.roles[marker - template.vocabulary] if marker < template.other else ""
    if marker == template.other:
        text_at = int(np.argmax(ids == template.role_end)) + 1
        role = template.unescape(decode(ids[1 : text_at - 1]))
    body = decode(ids[text_at:-1])
    loss = template.unescape(decode(ids[mask == 1]))
    return role, template.unescape(body), loss, template.opening(marker, role) + body + template.end


def _texted(df: DataFrame) -> DataFrame:
    """Ids as text: pandas would turn a long column with a null into floats."""
    return df.withColumns({c: F.col(c).cast("string") for c in ("conv_id", "turn")})


def _typed(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in ("conv_id", "turn")})


def format_chat(turns: DataFrame, template: Template | None = None, ranks_file: str | None = None) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, turn, ids, loss_mask: one row per turn, no shuffle."""
    template = template or Template()
    ranks_file = ranks_file or tokenizer_file("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load_encoding(ranks_file).encode_ordinary
        for b in batches:
            made = [assemble(encode, template, role, text) for role, text in zip(b["role"], b["text"])]
            yield pd.DataFrame({"conv_id": b["conv_id"], "turn": b["turn"], "ids": [m[0] for m in made], "loss_mask": [m[1] for m in made]})

    clean = turns.select(
        F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    made = clean.mapInPandas(run, "conv_id string, turn string, ids array<int>, loss_mask array<tinyint>")
    return _typed(made)


def with_offsets(formatted: DataFrame) -> DataFrame:
    """Adds token_offset: the place of a turn's first id in its conversation, by a prefix sum over turns."""
    order = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    return formatted.withColumn("token_offset", F.coalesce(F.sum(F.size("ids")).over(order), F.lit(0)))


def parse_chat(formatted: DataFrame, template: Template | None = None, ranks_file: str | None = None) -> DataFrame:
    """Inverse of `format_chat`: conv_id, turn, role, text, loss_text, formatted."""
    template = template or Template()
    ranks_file = ranks_file or tokenizer_file("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coded = load_encoding(ranks_file)

        def decode(ids: np.ndarray) -> str:
            return coded.decode_bytes(ids.tolist()).decode("utf-8")

        for b in batches:
            rows = [read_back(decode, template, np.asarray(i), np.asarray(m)) for i, m in zip(b["ids"], b["loss_mask"])]
            out = pd.DataFrame(rows, columns=["role", "text", "loss_text", "formatted"], dtype=object)
            yield pd.concat([b[["conv_id", "turn"]].reset_index(drop=True), out], axis=1)

    return _typed(_texted(formatted).mapInPandas(run, "conv_id string, turn string, role string, text string, loss_text string, formatted string"))


def digest_conversations(parsed: DataFrame) -> DataFrame:
    """Per conversation: turn count, digests and lengths of what `parse_chat` has read.

    Rows are dealt by conversation, sorted, and streamed past one running hash:
    memory doesn't depend on a conversation's length. A digest over a whole
    conversation is sequential by definition; all encoding is done before.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, done = None, None, []

        def flush():
            if state is not None:
                done.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for b in batches:
            for conv, role, text, loss, n in zip(b["conv_key"], b["role"], b["text"], b["loss_text"], b["formatted_chars"]):
                if conv != key or state is None:
                    flush()
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                loss = text if loss is None else loss
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += int(n)
            yield pd.DataFrame(done, columns=names)
            done.clear()
        flush()
        yield pd.DataFrame(done, columns=names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    # a loss text that equals its turn's text is not carried twice
    slim = parsed.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("conv_key"), "turn", "role", "text",
        F.when(F.col("loss_text") != F.col("text"), F.col("loss_text")).alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
    ordered = slim.repartition("conv_key").sortWithinPartitions("conv_key", "turn", "role", "text")
    made = ordered.mapInPandas(run, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return made.withColumn("conv_id", F.expr("if(conv_id = 'null', null, cast(conv_id as bigint))"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return digest_conversations(parse_chat(format_chat(turns.unionByName(extra))))
