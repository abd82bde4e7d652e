"""URL rules in a sorted digest array: 64-bit xxhash keys in a memory-mapped file, probed by binary search, confirmed by the strings.

A rule is an action with a host and a path, `allow example.org/en/`; it fits its host and all subdomains of it, if the path of the url
starts with the rule's path. Each url asks for the parts of its host and path that are as long as some rule's, whatever its own length. All digests of a batch are looked up at once in the sorted array; the stored string decides, so collisions are harmless.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, until_exit

#: Rule files that an application has been given.
_given: dict[str, set[str]] = {}
#: What a url gets that no rule fits.
DEFAULT = "allow"


class RuleFile:
    """One file: count, sorted keys, string ends, actions, strings. Rules are a parameter of the job, so their number doesn't follow the data."""

    @staticmethod
    def write(f: BinaryIO, rules: list[tuple[str, str, str]]) -> list[tuple[int, int]]:
        """Writes (action, host, path) rules; returns the lengths of hosts and paths that there are, long hosts first. Of equal rules the last one holds."""
        rows = {(h.translate(_LOWER) + p): (a, (len(h), len(p))) for a, h, p in rules}
        keyed = sorted((xxhash.xxh64_intdigest(name.encode()), name, a) for name, (a, _) in rows.items())
        strings = [n.encode() for _, n, _ in keyed]
        f.write(np.array([len(keyed)], np.int64).tobytes())
        f.write(np.array([k for k, _, _ in keyed], np.uint64).tobytes())
        f.write(np.cumsum([len(s) for s in strings], dtype=np.int64).tobytes())
        f.write(np.array([a == "block" for _, _, a in keyed], np.int64).tobytes())
        f.write(b"".join(strings) + b"\n")
        return sorted({n for _, n in rows.values() if n[0]}, reverse=True)

    def __init__(self, path: str) -> None:
        mapped = np.memmap(path, np.uint8, "r")
        n = int(mapped[:8].view(np.int64)[0])
        part = lambda i, kind: mapped[8 + 8 * n * i : 8 + 8 * n * (i + 1)].view(kind)
        self.keys, self.ends, self.blocks, self.strings = part(0, np.uint64), part(1, np.int64), part(2, np.int64), mapped[8 + 24 * n :]

    def string(self, i: int) -> bytes:
        return bytes(self.strings[(self.ends[i - 1] if i else 0) : self.ends[i]])

    def find(self, names: list[bytes]) -> list[int]:
        """The place of each name, -1 for those that aren't stored."""
        found = [-1] * len(names)
        if len(self.keys) and names:
            probe = np.array([xxhash.xxh64_intdigest(x) for x in names], np.uint64)
            at = np.searchsorted(self.keys, probe)
            for j in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == probe).tolist():
                i = int(at[j])
                while i < len(self.keys) and self.keys[i] == probe[j]:  # equal keys stand side by side
                    if self.string(i) == names[j]:
                        found[j] = i
                        break
                    i += 1
        return found


def parts_of(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path of a url; both empty without `://`."""
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    end = min([i for i in (rest.find(c) for c in "?#") if i >= 0], default=len(rest))
    return host.translate(_LOWER), rest[:end]


_LOWER = {c: c + 32 for c in range(65, 91)}


def judge_urls(spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages.

    The longest fitting rule (host and path together; ties to the longer host) decides; without one, rule is null and the verdict is DEFAULT. Null urls and
    those without `://` have an empty host and path. Rows keep their ids, null and repeated ones too; an empty table gives an empty one.
    Urls of any length take time in proportion to it. Other columns aren't read.
    """
    data = io.BytesIO()
    lengths = RuleFile.write(data, rules)
    name = f"rules-{hashlib.sha256(data.getvalue()).hexdigest()[:32]}.bin"
    if name not in _given.setdefault(spark.sparkContext.applicationId, set()):
        folder = shared_folder(spark, lasting=True)
        until_exit(spark, folder)
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/{name}") as f:
            f.write(data.getvalue())
        spark.sparkContext.addFile(f"{folder}/{name}")  # Spark copies it to each executor, where it is mapped; equal rules are given once
        _given[spark.sparkContext.applicationId].add(name)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleFile(SparkFiles.get(name))
        for batch in batches:
            hosts, paths, asked, owner = [], [], [], []
            for i, url in enumerate(batch.column(1).to_pylist()):
                host, path = parts_of(url)
                hosts.append(host)
                paths.append(path)
                if not host:
                    continue
                for h, n in lengths:
                    if n <= len(path) and (h == len(host) or h < len(host) and host[-h - 1] == "."):
                        asked.append((host[len(host) - h :] + path[:n]).encode())
                        owner.append(i)
            best = [-1] * len(hosts)
            for j, at in enumerate(index.find(asked)):
                if at >= 0:
                    i = owner[j]
                    if best[i] < 0 or len(asked[j]) > len(index.string(best[i])):  # longer hosts are asked first
                        best[i] = at
            rule = [index.string(b).decode() if b >= 0 else None for b in best]
            verdict = [DEFAULT if b < 0 else "block" if index.blocks[b] else "allow" for b in best]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string").alias("url")).mapInArrow(rows, f"page_id {kind}, host string, path string, rule string, verdict string")
