"""URL rules looked up in a memory-mapped array of sorted 64-bit digests.

The rule set is written once as two arrays, the sorted xxhash64 keys of `host path` and the records they stand for,
and goes to every node as files; workers map them instead of loading them. A url's candidates are its host's suffixes at
label borders times its path's prefixes of the lengths that rules have; all candidates of a batch are found by one
binary search, and a hit counts only if the stored rule equals the candidate in full, so a collision cannot match.
"""

from __future__ import annotations

import atexit
import hashlib
import json
import os
import shutil
import tempfile
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.common import LOWER, UPPER, slices

#: Fixed: the rules of the registered query (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
_LOWER = str.maketrans(UPPER, LOWER)


def parts(url: str | None) -> tuple[str, str]:
    """Host and path: both empty for null and where there is no `://`."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    return host.translate(_LOWER), rest[:end]


def _key(host: str, path: str) -> int:
    return xxhash.xxh64_intdigest(f"{host} {path}")


def write_index(rules: Iterable[tuple[str, str, str]], folder: str) -> str:
    """The files of a rule set in folder; returns their common name, which its content gives. Of equal rules block wins."""
    best: dict[tuple[str, str], str] = {}
    for verdict, host, path in rules:
        host = host.translate(_LOWER)
        best[host, path] = "block" if "block" in (verdict, best.get((host, path))) else "allow"
    rows = sorted((_key(h, p), h, p, v) for (h, p), v in best.items())
    stored = [json.dumps([h, p, v]).encode() for _, h, p, v in rows]
    ends = np.cumsum([0, *map(len, stored)])
    name = "urlrules-" + hashlib.sha256(b"\n".join(stored)).hexdigest()[:24]
    np.save(f"{folder}/{name}-keys.npy", np.array([r[0] for r in rows], dtype=np.uint64))
    np.save(f"{folder}/{name}-ends.npy", ends.astype(np.int64))
    np.save(f"{folder}/{name}-text.npy", np.frombuffer(b"".join(stored) or b" ", dtype=np.uint8))
    np.save(f"{folder}/{name}-lens.npy", np.array(sorted({len(p) for _, _, p, _ in rows}), dtype=np.int64))
    return name


class Index:
    """The mapped arrays of a rule set."""

    def __init__(self, folder: str, name: str):
        self.keys, self.ends, self.text, self.lens = (
            np.load(os.path.join(folder, f"{name}-{part}.npy"), mmap_mode="r") for part in ("keys", "ends", "text", "lens")
        )

    def stored(self, i: int) -> list[str]:
        return json.loads(self.text[self.ends[i] : self.ends[i + 1]].tobytes())

    def look_up(self, pairs: list[tuple[str, str]]) -> list[tuple[str, str] | None]:
        """For each host and path the rule (as text, with its verdict) that fits and is longest; ties: the longer host."""
        hosts, paths, owner, keys = [], [], [], []
        for i, (host, path) in enumerate(pairs):
            prefixes = [path[:n] for n in self.lens if n <= len(path)]
            while host:
                for p in prefixes:
                    hosts.append(host)
                    paths.append(p)
                    owner.append(i)
                    keys.append(_key(host, p))
                host = host.partition(".")[2]
        out: list[tuple[str, str] | None] = [None] * len(pairs)
        rank = [(-1, -1)] * len(pairs)
        asked = np.array(keys, dtype=np.uint64)
        at = np.searchsorted(self.keys, asked)
        for k in np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == asked)) if len(self.keys) else ():
            j = int(at[k])
            while j < len(self.keys) and self.keys[j] == asked[k]:  # rules that share a key stand side by side
                host, path, verdict = self.stored(j)
                i, r = owner[k], (len(host) + len(path), len(host))
                if (host, path) == (hosts[k], paths[k]) and r > rank[i]:
                    rank[i], out[i] = r, (host + path, verdict)
                j += 1
        return out


@lru_cache(maxsize=4)
def _open(folder: str, name: str) -> Index:
    return Index(folder, name)


def _judged(name: str, otherwise: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _open(os.path.dirname(SparkFiles.get(f"{name}-keys.npy")), name)
        for batch in slices(batches):
            pairs = [parts(u) for u in batch.column(batch.num_columns - 1).to_pylist()]
            found = index.look_up(pairs)
            new = [[h for h, _ in pairs], [p for _, p in pairs], [f and f[0] for f in found], [f[1] if f else otherwise for f in found]]
            arrays = [*batch.columns[:-1], *(pa.array(x, pa.string()) for x in new)]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:-1], "host", "path", "rule", "verdict"])

    return run


def url_filter(
    spark: SparkSession,
    rows: DataFrame,
    carry: list[str],
    rules: Iterable[tuple[str, str, str]] = RULES,
    otherwise: str = "allow",
    url: str = "url",
) -> DataFrame:
    """The carried columns of rows with host, path, rule and verdict.

    Rules are (verdict, host, path); one fits its host and all subdomains where the url's path starts with the rule's.
    The longest rule wins, at equal length the one with the longer host. A url that no rule fits gets `otherwise`.
    The index goes to the nodes as files, so a node that joins later fetches it too.

    Defined cases: a null url and one without `://` have empty host and path and fit no rule; an empty rule set gives
    `otherwise` throughout; a url of any length is judged whole; an empty table gives an empty result; repeated rows are
    judged each; carried columns that have a name of the four new ones are replaced.
    """
    carry = [c for c in carry if c.lower() not in ("host", "path", "rule", "verdict")]
    folder = tempfile.mkdtemp(prefix="corpusloom-rules-")  # the driver serves the files from here until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = write_index(rules, folder)
    sent = {os.path.basename(f) for f in spark.sparkContext.listFiles}
    for part in ("keys", "ends", "text", "lens"):
        if f"{name}-{part}.npy" not in sent:
            spark.sparkContext.addFile(f"{folder}/{name}-{part}.npy")
    own = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carry)
    return rows.select(*carry, url).mapInArrow(_judged(name, otherwise), f"{own}, host string, path string, rule string, verdict string")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id"])


OP6_SQL = r"""
WITH rules(verdict, host, path) AS (VALUES
       ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
       ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
     cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
     p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
     fits AS (SELECT p.page_id, r.verdict, r.host || r.path AS rule,
                     row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
              FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM p LEFT JOIN fits f ON f.page_id = p.page_id AND f.k = 1
"""
