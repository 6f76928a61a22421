"""Secret scans with corpus-wide ownership frequency."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch_of, cut, narrow, texts_of

# The base kinds, in the order that breaks ties, then the kinds that this method adds.
KINDS = ("assign", "access", "hex", "github", "slack", "jwt", "pem")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ADDED = {
    "github": re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"),
    "slack": re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "pem": re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
}
#: A text without the word can't match the expression; looking for a word is far cheaper.
NEEDS = {"github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "slack": ("xox",), "jwt": ("eyJ",), "pem": ("PRIVATE KEY-----",)}
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: Characters of a key's body at least, without white space; owners, and repositories, of an example at least.
MIN_PEM, MIN_OWNERS, MIN_REPOS = 16, 3, 10
#: What follows a header where no footer does, and what a body's lines are parted by, as written in code too.
PEM_BODY, PEM_BREAKS = re.compile(r"(?:[A-Za-z0-9+/=\s]|\\[nrt])*", re.ASCII), re.compile(r"\s+|\\[nrt]")

_IS_HEX = np.zeros(256, dtype=bool)
_IS_HEX[[*b"0123456789abcdef"]] = True


def _long_hex(text: str) -> list[tuple[int, int]]:
    """Runs of lower-case hex digits, MIN_HEX or longer: (start, end)."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    stops = np.flatnonzero(~_IS_HEX[raw])
    edges = np.concatenate(([-1], stops, [len(raw)]))
    if len(raw) < MIN_HEX or np.diff(edges).max() <= MIN_HEX:
        return []
    return [m.span() for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX]


def spans_of(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind number, end, value start, value end) of every candidate, by start, then kind."""
    found = []
    low = text.lower()
    if any(word in low for word in KEYWORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= MIN_ASSIGN:
                found.append((m.start(), 0, m.end(), m.start(2), m.end(2)))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(a, 2, b, a, b) for a, b in _long_hex(text)]
    for kind, pattern in ADDED.items():
        if any(word in text for word in NEEDS[kind]):
            k = KINDS.index(kind)
            matches = list(pattern.finditer(text))
            values = _bodies(text, [m.span() for m in matches]) if kind == "pem" else [m.span() for m in matches]
            found += [(m.start(), k, m.end(), v, w) for m, (v, w) in zip(matches, values)]
    return sorted(found)


def _bodies(text: str, headers: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Where the body of each key lies: as far as its footer, or else as its letters go."""
    out, footer = [], 0
    for (_, start), following in zip(headers, [*(a for a, _ in headers[1:]), len(text)]):
        if 0 <= footer < start:
            footer = text.find("-----END", start)
        out.append((start, footer if start <= footer <= following else PEM_BODY.match(text, start, following).end()))
    return out


def _value(text: str, kind: int, start: int, end: int) -> str:
    """A candidate value; of a key its body without breaks, empty if there is next to none."""
    if kind != 6:
        return text[start:end]
    body = PEM_BREAKS.sub("", text[start:end])
    return body if len(body) >= MIN_PEM else ""


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _, _ in spans)


def _scan(batch: pa.RecordBatch) -> pa.RecordBatch:
    counts, base, joined, values = [], [], [], []
    for text in texts_of(batch.column("text")):
        spans = spans_of(text)
        own = [s for s in spans if s[1] < 3]
        counts.append([sum(s[1] == k for s in own) for k in range(3)])
        base.append(hashlib.sha256(_joined(own).encode()).hexdigest())
        joined.append(_joined(spans))
        values.append(sorted({hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()[:32] for _, k, _, v, w in spans if (x := _value(text, k, v, w))}))
    counts = np.array(counts, dtype=np.int64).reshape(-1, 3)
    return batch_of(["id", "owner", "repo", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "hashes"], [batch.column("id"), batch.column("owner"), batch.column("repo"), *(counts[:, k].copy() for k in range(3)), base, joined, pa.array(values, pa.list_(pa.string()))])


def scan(df: DataFrame, text: str = "text", doc_id: str = "doc_id", owner: str = "source", repo: str = "doc_id") -> DataFrame:
    """One row per row of df: its spans and the hashes of the candidate values in it.

    Null text is the empty text: no spans. Spans are code points, end exclusive, sorted by start, then kind.
    """
    schema = f"id {df.schema[doc_id].dataType.simpleString()}, owner string, repo string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, hashes array<string>"
    rows = narrow(df, id=doc_id, text=text, owner=owner, repo=repo).withColumns({"owner": F.col("owner").cast("string"), "repo": F.col("repo").cast("string")})
    return arrow_map(rows, _scan, schema)


def ownership(scanned: DataFrame, min_owners: int = MIN_OWNERS, min_repos: int = MIN_REPOS) -> DataFrame:
    """hash, n_repos, n_owners, n_rows, live: how many distinct repositories and owners hold each candidate value.

    A value that min_owners or more owners hold, or min_repos or more repositories of however few owners, is a copied
    example; any other looks live. Null owners and
    repositories count as one owner and one repository of their own. Copies of a value within an owner are summed before
    anything is dealt out by hash, so a value that a third of all rows hold costs a row per owner and task.
    """
    one = scanned.select(F.explode("hashes").alias("hash"), F.coalesce("owner", F.lit("\0")).alias("owner"), F.coalesce("repo", F.lit("\0")).alias("repo"))
    by_repo = one.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    repos = by_repo.groupBy("hash", "repo").agg(F.sum("n").alias("n")).groupBy("hash").agg(F.count(F.lit(1)).alias("n_repos"), F.sum("n").alias("n_rows"))
    owners = one.select("hash", "owner").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"))
    return repos.join(owners, "hash").withColumn("live", (F.col("n_owners") < min_owners) & (F.col("n_repos") < min_repos))


def secret_scan(df: DataFrame, text: str = "text", doc_id: str = "doc_id", owner: str = "source", repo: str = "doc_id", min_owners: int = MIN_OWNERS, min_repos: int = MIN_REPOS) -> DataFrame:
    """Every row's candidate secrets, and how many of them look live by corpus-wide ownership.

    Columns: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live (distinct values that look
    live, see ownership()), n_examples (the others), live_hashes (sorted), hashes (all, sorted), n_repos and n_owners (how
    many hold each of hashes). Each row of df gives one row, repeated and
    null ids included; an empty table gives none. Texts are scanned whole.
    """
    # The scan is kept, without the texts, so they are read once.
    rows = cut(scan(df, text, doc_id, owner, repo)).withColumn("row", F.monotonically_increasing_id())
    verdicts = ownership(rows, min_owners, min_repos).select("hash", "live", "n_repos", "n_owners")
    judged = (
        rows.select("row", F.explode("hashes").alias("hash"))
        .join(verdicts, "hash")
        .groupBy("row")
        .agg(F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_examples"), F.sort_array(F.collect_list(F.struct("hash", "live", "n_repos", "n_owners"))).alias("all"))
    )
    return rows.join(judged, "row", "left").select(
        F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans",
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_examples", F.lit(0)).alias("n_examples"),
        F.coalesce(F.transform(F.filter("all", lambda x: x.live), lambda x: x.hash), F.array().cast("array<string>")).alias("live_hashes"), "hashes",
        *[F.coalesce(F.col(f"all.{c}"), F.array().cast("array<long>")).alias(c) for c in ("n_repos", "n_owners")],
    )
