"""URL filters: a memory-mapped sorted array of 64-bit digests, probed by vectorised binary search."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import shared_file, small_batches

#: Rules of verdict, host and path; the longest that fits decides.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Hosts of the filter list: each blocks itself and its subdomains where no rule fits.
BLOCKED_HOSTS = ("ads-track.example.com", "adult-x.example.net", "casino-win.example.com", "cheap-pills.example.com", "free-bets.example.com", "spam-farm.example.com")
LIST_BYTES = 256 << 20


def digests(keys: Sequence[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))


class DigestArray:
    """Strings in the order of their digests, in one file: digests, string offsets, string bytes; mapped, not read."""

    def __init__(self, path: str):
        whole = np.memmap(path, np.uint8, "r")
        n = int(whole[:8].view(np.uint64)[0])
        self.digest = whole[8 : 8 + 8 * n].view(np.uint64)
        self.offset = whole[8 + 8 * n : 16 + 16 * n].view(np.uint64)
        self.bytes = whole[16 + 16 * n :]

    @staticmethod
    def image(keys: Sequence[str]) -> bytes:
        keys = sorted(set(keys))
        d = digests(keys)
        order = np.argsort(d, kind="stable")
        raw = [keys[i].encode() for i in order]
        offset = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.uint64)
        return np.array([len(keys)], np.uint64).tobytes() + d[order].tobytes() + offset.tobytes() + b"".join(raw)

    def contains(self, keys: Sequence[str], found: np.ndarray | None = None) -> np.ndarray:
        """Which keys are stored. ``found`` may give the keys' digests."""
        d = digests(keys) if found is None else found
        out = np.zeros(len(keys), bool)
        if not len(self.digest):
            return out
        at = np.searchsorted(self.digest, d)
        for i in np.flatnonzero(self.digest[np.minimum(at, len(self.digest) - 1)] == d):
            k, raw = int(at[i]), keys[i].encode()
            while k < len(self.digest) and self.digest[k] == d[i]:  # several strings may share a digest
                if self.bytes[int(self.offset[k]) : int(self.offset[k + 1])].tobytes() == raw:
                    out[i] = True
                    break
                k += 1
        return out


_open: dict[str, DigestArray] = {}


def _array(name: str) -> DigestArray:
    """The array in a file that the executor has fetched; all its workers map the same pages."""
    if name not in _open:
        _open[name] = DigestArray(SparkFiles.get(name))
    return _open[name]


def read_hosts(lists: DataFrame) -> list[str]:
    """The hosts of published block lists, in order (``value`` string, as from ``spark.read.text``).

    A line is a host, a line of a hosts file (address, host) or a filter ``||host^``; comments after ``#`` and
    lines that begin with ``!`` don't count, nor do ``localhost`` and names without a dot.
    """
    line = F.trim(F.regexp_replace(F.lower("value"), r"#.*$|\^.*$", ""))
    host = F.regexp_replace(F.element_at(F.split(line, r"\s+"), -1), r"^\|\||\.$", "")
    hosts = lists.where(~F.trim("value").startswith("!")).select(host.alias("host")).where(r"host rlike '^[^/:*|]+[.][^/:*|.]+$' and not host rlike '^[0-9.]+$'")
    return sorted(r["host"] for r in hosts.distinct().collect())


def suffixes(host: str) -> list[str]:
    """The host and its parent domains, longest first."""
    parts = host.split(".")
    return [".".join(parts[i:]) for i in range(len(parts))] if host else []


def _judge(rules_file: str, hosts_file: str, verdicts: dict[str, str], path_lengths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, hosts = _array(rules_file), _array(hosts_file)
        for batch in batches:
            names, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            domains: dict[str, list[str]] = {h: suffixes(h) for h in set(names)}
            keys, row = [], []
            for i, (h, p) in enumerate(zip(names, paths, strict=True)):
                for s in domains[h]:
                    for n in path_lengths:
                        if n <= len(p):
                            keys.append(s + p[:n])
                            row.append(i)
            best: list[str | None] = [None] * len(names)
            for k in np.flatnonzero(rules.contains(keys)):
                if best[row[k]] is None or len(keys[k]) > len(best[row[k]]):
                    best[row[k]] = keys[k]
            every = sorted({s for d in domains.values() for s in d})
            bad = {s for s, x in zip(every, hosts.contains(every), strict=True) if x}
            listed = {h for h, d in domains.items() if bad.intersection(d)}
            verdict = [verdicts[r] if r is not None else "block" if h in listed else "allow" for r, h in zip(best, names, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(best, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return run


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, blocked: Sequence[str] = BLOCKED_HOSTS) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url); other columns are not read.

    A rule fits its host and all subdomains where the path starts with the rule's path; of those that
    fit, the longest wins (rules must be distinct as host + path). Where none fits, a host on the list
    ``blocked``, or a subdomain of one, is blocked and any other allowed. Both are sorted digest arrays;
    a digest that is found counts only if the stored string is equal. The arrays are files in the shared
    folder that every executor fetches once and its workers map; they may hold ``LIST_BYTES`` at most (some
    ten million hosts), and a longer list is refused. ``blocked`` may come from :func:`read_hosts`.

    Null urls and urls without ``://``: empty host and path, no rule, allowed. Repeated rows each get a
    row, a null page_id is carried, an empty table gives none. Urls of any length are judged whole; no two
    rules can tie, since equal ones would be of equal host and path.
    """
    spark = pages.sparkSession
    small_batches(spark)
    images = [DigestArray.image([h + p for _, h, p in rules]), DigestArray.image([b.lower() for b in blocked])]
    if sum(map(len, images)) > LIST_BYTES:
        raise ValueError(f"filter lists above {LIST_BYTES} bytes")
    shared = [shared_file(spark, x) for x in images]
    there = F.instr("url", "://")
    rest = F.when(there > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    parts = pages.select("page_id", F.coalesce(rest, F.lit("")).alias("rest")).select(
        "page_id", F.translate(F.regexp_extract("rest", "^([^/?#]*)", 1), upper, lower).alias("host"), F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1).alias("path")
    )
    lengths = sorted({len(p) for _, _, p in rules})
    kind = pages.schema["page_id"].dataType.simpleString()
    return parts.mapInArrow(_judge(*shared, {h + p: v for v, h, p in rules}, lengths), f"page_id {kind}, host string, path string, rule string, verdict string")
