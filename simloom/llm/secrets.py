"""Secrets in texts, told apart by corpus-wide ownership frequency.

Base spans come from fixed patterns.  Candidates are the base spans' values and
further key-like tokens; their hashes are counted by distinct repositories and
distinct owners over the whole corpus.  A value that many owners hold, or very
many repositories, is an example that was copied around; one that few hold, and
that looks random, is taken for a live credential.  Tokens of the latter kind add spans of
kind ``owned``; base spans stay, whatever their verdict.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from simloom.llm.arrays import slices, tidy
from simloom.scratch import Scratch

# The base kinds in the order in which they are listed.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
# A shorter run fails its kind's length and so needs no match of its own.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE = 8
#: Key-like tokens beyond the base kinds: so long, with a digit and a letter, with so many bits a character.
_KEYLIKE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}")
OWNED = "owned"
LEAST_BITS = 3.0
#: Owners from which on a value counts as copied, and repositories: a value that
#: one owner's many repositories hold is a template of that owner's.
COPIED_BY, COPIED_IN = 3, 12


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, value start, value end) of the base kinds, by start and then kind."""
    found = [(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    found += [(m.start(), k, m.end(), m.start(), m.end()) for k, of in ((1, _ACCESS), (2, _HEX)) for m in of.finditer(text)]
    return sorted(found)


def bits(value: str) -> float:
    """Entropy of a value's characters, in bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def candidates(text: str) -> list[tuple[int, int, int, int, float]]:
    """(start, kind, end, hash, bits) of base spans and key-like tokens; kind 3 is key-like."""
    base = base_spans(text)
    rows = [(a, k, b, text[x:y]) for a, k, b, x, y in base]
    # Both come by their start; ``reach`` is where the base spans before a token end.
    at, reach = 0, -1
    for m in _KEYLIKE.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            reach, at = max(reach, base[at][2]), at + 1
        if reach <= m.start() and bits(value := m.group()) >= LEAST_BITS:
            rows.append((m.start(), 3, m.end(), value))
    return [(a, k, b, int.from_bytes(hashlib.blake2b(v.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True), bits(v)) for a, k, b, v in sorted(rows)]


def _describe(span: tuple) -> str:
    a, k, b = span[:3]
    return f"{(*KINDS, OWNED)[k]}:{a}:{b}"


_FOUND = "array<struct<start:long,kind:int,end:long,hash:long,bits:double>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # A row's key is written with it; a task that runs again gives the same ones.
    key = TaskContext.get().partitionId() << 40
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("hash", pa.int64()), ("bits", pa.float64())]))
    names = ("start", "kind", "end", "hash", "bits")
    for part in slices(batches):
        found = [candidates(t) if t else [] for t in part.column(1).to_pylist()]
        digests = [hashlib.sha256(",".join(_describe(s) for s in of if s[1] < 3).encode()).hexdigest() for of in found]
        counts = np.array([[sum(s[1] == k for s in of) for k in range(3)] for of in found], np.int64).reshape(-1, 3)
        keys = pa.array(np.arange(key, key + part.num_rows))
        key += part.num_rows
        yield pa.RecordBatch.from_arrays(
            [keys, part.column(0), part.column(2), part.column(3), *(pa.array(counts[:, k]) for k in range(3)), pa.array(digests), pa.array([[dict(zip(names, s, strict=True)) for s in of] for of in found], kind)],
            names=["key", "doc_id", "repo", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "found"],
        )


def ownership(found: DataFrame) -> DataFrame:
    """``hash, n_rows, n_repos, n_owners`` of candidate hashes over a corpus.

    ``found`` has ``hash, repo, owner``; a null repository or owner is one like
    any other.  A hash that a third of all rows hold is summed on the map side,
    first by repository and owner and then alone.
    """
    each = found.groupBy("hash", "repo", "owner").agg(F.count(F.lit(1)).alias("n"))
    repos = each.groupBy("hash", "repo").agg(F.sum("n").alias("n")).groupBy("hash").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_repos"))
    owners = each.select("hash", "owner").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"))
    return repos.join(owners, "hash")


def secrets(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", repo_col: str | Column = "source", owner_col: str | Column = "source", copied_by: int = COPIED_BY, copied_in: int = COPIED_IN
) -> DataFrame:
    """One row for each input row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, n_owned, found``.

    ``spans`` joins ``kind:start:end`` (code points, end exclusive) of all spans
    by start and then kind, ``found`` has them as structs with the verdict.  A
    null or empty text has no spans; repeated rows and ids get a row each; a
    null repository or owner is one like any other; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    column = lambda c: F.col(c) if isinstance(c, str) else c
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), column(repo_col).cast("string").alias("repo"), column(owner_col).cast("string").alias("owner")
    )
    base = "n_assign long, n_access long, n_hex long, base_sha256 string"
    seen = scratch.table(source.mapInArrow(tidy(_scan), f"key long, doc_id long, repo string, owner string, {base}, found {_FOUND}"), "seen")
    each = seen.where(F.size("found") > 0).select("key", "repo", "owner", F.explode("found").alias("s")).select("key", "repo", "owner", "s.*")
    owned = ownership(each.select("hash", "repo", "owner"))
    copied = (F.col("n_owners") >= copied_by) | (F.col("n_repos") >= copied_in)
    live = ~copied & (F.col("bits") >= LEAST_BITS)
    judged = (
        each.join(owned, "hash")
        .where((F.col("kind") < len(KINDS)) | live)
        .groupBy("key")
        .agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", live.alias("live"), copied.alias("copied"), "n_repos", "n_owners"))).alias("spans_of"))
    )
    names = F.array(*map(F.lit, (*KINDS, OWNED)))
    spans = F.coalesce("spans_of", F.expr("array()"))
    text = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")
    return seen.join(judged, "key", "left").select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        "base_sha256",
        text.alias("spans"),
        F.size(F.filter(spans, lambda s: s.live)).cast("long").alias("n_live"),
        F.size(F.filter(spans, lambda s: s.copied)).cast("long").alias("n_copied"),
        F.size(F.filter(spans, lambda s: s.kind == len(KINDS))).cast("long").alias("n_owned"),
        spans.alias("found"),
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, redacted = [], []
        for text, owned in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            owned = set(owned or ())
            spans = [(s[0], s[2], s[1]) for s in candidates(text) if s[1] < len(KINDS) or s[3] in owned] if text else []
            out, last = [], 0
            for a, b, k in spans:  # overlapping spans become one
                if a >= last:
                    out += [text[last:a], f"<{(*KINDS, OWNED)[k]}-secret>"]
                last = max(last, b)
            texts.append("".join([*out, text[last:]]) if spans else text)
            redacted.append(bool(spans))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(redacted, pa.bool_())], names=["row", "text", "redacted"])


def redact(
    docs: DataFrame, *, text_col: str = "text", repo_col: str = "source", owner_col: str = "source", copied_by: int = COPIED_BY, copied_in: int = COPIED_IN, flag_col: str = "redacted"
) -> DataFrame:
    """The rows of ``docs`` with base and live owner-specific spans replaced in the text, and ``flag_col``, which takes the place of a column of its name.

    Each row is judged by its own text, so repeated ids do no harm.  Only the
    few rows with key-like tokens take part in a join; null and empty texts stay
    as they are; other columns, whatever their names, are carried along.  No
    rows give no rows.
    """
    scratch = Scratch(docs.sparkSession, "redact")
    text = F.col(text_col).cast("string")
    source = docs.select(F.lit(None).cast("long").alias("doc_id"), text.alias("text"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"))
    seen = scratch.table(
        source.mapInArrow(tidy(_scan), f"key long, doc_id long, repo string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, found {_FOUND}")
        .where(F.size("found") > 0)
        .select("repo", "owner", F.explode("found").alias("s"))
        .select("repo", "owner", "s.hash", "s.kind", "s.bits"),
        "seen",
    )
    extra = seen.where((F.col("kind") == len(KINDS)) & (F.col("bits") >= LEAST_BITS)).select("hash").distinct()
    few = (F.col("n_owners") < copied_by) & (F.col("n_repos") < copied_in)
    owned = scratch.table(ownership(seen.select("hash", "repo", "owner")).where(few).join(extra, "hash", "left_semi").select("hash"), "owned")
    # The caller's columns travel in one struct, so that none of their names can clash.
    carried = [c for c in docs.columns if c not in (text_col, flag_col)]
    row = F.struct(*[F.col(f"`{c}`") for c in carried]) if carried else F.struct(F.lit(0).alias("none"))
    rows = docs.select(row.alias("row"), text.alias("text"))
    schema = StructType([rows.schema["row"], StructField("text", StringType()), StructField("redacted", BooleanType())])
    if owned.isEmpty():
        rows = rows.withColumn("owned_hashes", F.array().cast("array<long>"))
    else:
        # Which tokens are owned travels with the text's own hashes; null texts have none and are spread out.
        key = F.when(F.col("text").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64("text"))
        tagged = scratch.table(rows.where("text is not null").select(F.xxhash64("text").alias("key"), "text").mapInArrow(tidy(_hashes), "key long, hash long"), "tagged")
        per_text = tagged.join(owned, "hash", "left_semi").groupBy("key").agg(F.collect_set("hash").alias("owned_hashes"))
        rows = rows.withColumn("key", key).join(per_text, "key", "left").select("row", "text", "owned_hashes")
    out = rows.mapInArrow(tidy(_cut), schema)
    back = [F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != flag_col]
    return out.select(*back, F.col("redacted").alias(flag_col))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        rows = [(key, s[3]) for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if text for s in candidates(text) if s[1] == len(KINDS)]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([h for _, h in rows], pa.int64())], names=["key", "hash"])
