"""WARC files and a Merkle fixity audit of their replicas.

Records are gzip members of .warc.gz files. They are hashed as they are stored: SHA-256 of
all bytes of a member, packing included, so that no changed byte goes unseen. In each file
the hashes, with the range of stored offsets that each covers, are the leaves of a tree of
``FAN`` children a node; a node's hash is that of its children's hashes and of its range.
File roots, in order of file name, are the leaves of the tree over files. Two replicas are
audited from the top: where the roots agree nothing below is looked at, else only the
children of nodes that differ are compared, down to the records, whose offsets tell where
in the file the corruption is. Files that one replica lacks are found by their roots.

A file is bounded by ``records`` and ``size`` when it is written, so a task hashes a file
without a shuffle. Members are unpacked only to name their record. What can't be unpacked or
parsed is a leaf ``broken`` up to the next member that begins a record, and the leaves cover
a file from its first byte to its last. A null page is an empty body, a null url an empty
target, a null id an empty name; records of the same id are leaves of their own. Empty
tables give no files and no rows; other columns make no difference.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, partitions, release, slices, text_batches, written

FAN = 16
DATE = "2026-01-01T00:00:00Z"
#: size and content (SHA-256) are of the unpacked record, null where it can't be unpacked.
NODES = "replica string, name string, level int, node long, start long, end long, hash string, id string, size long, content string"
MAGIC = b"\x1f\x8b\x08"


def record(url: str | None, body: bytes, key: str, date: str = DATE) -> bytes:
    """A WARC/1.1 resource record."""
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:vecmill:{key}>\r\nWARC-Date: {date}\r\nWARC-Target-URI: {url or ''}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def packed(raw: bytes) -> bytes:
    """A record as a gzip member of its own, as in .warc.gz files."""
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def unpack(raw: bytes, at: int) -> tuple[bytes, int]:
    """What the member at an offset holds, and where it ends."""
    z, parts, end, view = zlib.decompressobj(31), [], at, memoryview(raw)
    while not z.eof:
        if end >= len(raw):
            raise zlib.error("cut off")
        parts.append(z.decompress(view[end : end + 16384]))
        end += 16384
    return b"".join(parts), min(end, len(raw)) - len(z.unused_data)


def begins(raw: bytes, at: int) -> bool:
    """Whether a member that holds a record begins here, however it goes on."""
    try:
        return zlib.decompressobj(31).decompress(memoryview(raw)[at : at + 1024], 7) == b"WARC/1."
    except zlib.error:
        return False


def members(raw: bytes):
    """(start, end, unpacked or None) of the stretches of a .warc.gz file, which cover it all. None is
    what can't be unpacked, up to the next member."""
    at = 0
    while at < len(raw):
        try:
            one, end = unpack(raw, at)
        except zlib.error:
            one, end = None, raw.find(MAGIC, at + 1)
            while end >= 0 and not begins(raw, end):
                end = raw.find(MAGIC, end + 1)
            end = len(raw) if end < 0 else end
        yield at, end, one
        at = end


def parse(raw: bytes):
    """(start, end, record or None, headers) of each stretch of a file, in stored offsets. Headers are
    None where there is no record that can be read."""
    for start, end, one in members(raw):
        headers = None
        if one is not None:
            try:
                head = one.index(b"\r\n\r\n")
                if not one.startswith(b"WARC/1."):
                    raise ValueError
                lines = one[:head].split(b"\r\n")[1:]
                headers = {k.strip().lower().decode(): v.strip().decode() for k, v in (x.split(b":", 1) for x in lines)}
                if int(headers["content-length"]) != len(one) - head - 8:
                    raise ValueError
            except (ValueError, KeyError):
                headers = None
        yield start, end, one, headers


def write_warc(pages: DataFrame, folder: str, damage=None, records: int = 1024, size: int = 64 << 20, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Writes the pages as WARC files and returns the manifest (name, path, n_records, n_bytes), a
    written table. ``damage(key, record, member)`` returns the stored bytes that the copy holds in place
    of a record's member, and then each file is written twice: as it is and, in the manifest's
    ``copy``, damaged."""

    text_batches(pages.sparkSession)

    def run(batches):
        release()
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        held: list[tuple[str, bytes]] = []

        def flush():
            name = uuid.uuid4().hex
            paths = [f"{root}/{name}.warc.gz", f"{root}/{name}.copy.warc.gz"][: 2 if damage else 1]
            whole = [packed(r) for _, r in held]
            for p, change in zip(paths, (None, damage)):
                with fs.open_output_stream(p, compression=None) as f:
                    for (key, r), z in zip(held, whole):
                        f.write(change(key, r, z) if change else z)
            row = [name, paths[0], paths[-1], len(held), sum(len(r) for _, r in held)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], ["name", "path", "copy", "n_records", "n_bytes"])

        n = 0
        for b in slices(batches, 64):
            for key, url, body in zip(b["key"].to_pylist(), b["url"].to_pylist(), b["body"].to_pylist()):
                held.append((key, record(url, (body or "").encode(), key)))
                n += len(held[-1][1])
                if len(held) >= records or n >= size:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    src = pages.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.col(url_col).alias("url"), F.col(body_col).alias("body"))
    return written(src.mapInArrow(run, "name string, path string, copy string, n_records long, n_bytes long"), "warc-manifest")


def _parent(hashes: list[str], start: int, end: int) -> str:
    return hashlib.sha256(f"{start}-{end}:{','.join(hashes)}".encode()).hexdigest()


def file_trees(files: DataFrame, folder: str, fan: int = FAN) -> DataFrame:
    """The nodes (NODES) of each file's tree; files: replica, name, path. Leaves (level 0) have the id
    of their record; the root has the file's highest level. A file is a task's, whole."""

    def run(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for replica, name, path in zip(*(b[c].to_pylist() for c in ("replica", "name", "path"))):
                with fs.open_input_file(path) as f:
                    raw = f.read()
                level, rows = 0, []
                now = []
                for start, end, one, headers in parse(raw):
                    key = (headers or {}).get("warc-record-id", "broken").removeprefix("<urn:vecmill:").removesuffix(">")
                    own = (None, None) if one is None else (len(one), hashlib.sha256(one).hexdigest())
                    now.append((start, end, hashlib.sha256(raw[start:end]).hexdigest(), key, *own))
                while True:
                    rows += [(level, i, *x) for i, x in enumerate(now)]
                    if len(now) <= 1:
                        break
                    level += 1
                    groups = [now[i : i + fan] for i in range(0, len(now), fan)]
                    now = [(g[0][0], g[-1][1], _parent([x[2] for x in g], g[0][0], g[-1][1]), None, None, None) for g in groups]
                for at in range(0, len(rows), 4096):
                    part = list(zip(*rows[at : at + 4096]))
                    n = len(part[0])
                    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([replica] * n), pa.array([name] * n), *(pa.array(c, k) for c, k in zip(part, kinds))], ["replica", "name", "level", "node", "start", "end", "hash", "id", "size", "content"])

    return files.select("replica", "name", "path").repartition(partitions(files.sparkSession), "path").mapInArrow(run, NODES)


def forest(roots: DataFrame, fan: int = FAN) -> list[DataFrame]:
    """The levels over file roots (replica, name, hash), least first, to one root a replica: node, hash.
    A node's children are at most ``fan``; which file is whose child follows from its name."""
    names = roots.select("name").distinct()
    count = names.count()
    depth = 0
    while fan**depth < max(count, 1):
        depth += 1
    # Names are hashes: their first hex digits spread them evenly over the leaves' parents.
    level = roots.select("replica", F.conv(F.substring(F.sha2("name", 256), 1, 15), 16, 10).cast("long").alias("at"), "name", "hash")
    levels = []
    for d in range(depth, -1, -1):
        node = F.shiftright(F.col("at"), 60 - 4 * d) if d else F.lit(0).cast("long")
        own = level.groupBy("replica", node.alias("node")).agg(F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("at", "name", "hash"))), lambda x: x["hash"])), 256).alias("hash"))
        own = written(own, "forest")
        levels.append(own)
        level = own.select("replica", F.shiftleft("node", 60 - 4 * d).alias("at"), F.lit("").alias("name"), "hash") if d else None
    return levels


def _differ(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose hashes differ, or that one side lacks."""
    pair = a.select(*keys, F.col("hash").alias("x")).join(b.select(*keys, F.col("hash").alias("y")), keys, "full")
    return pair.where(~F.col("x").eqNullSafe(F.col("y"))).select(*keys)


def audit(nodes: DataFrame, first: str = "original", second: str = "copy", fan: int = FAN) -> DataFrame:
    """name, node, start and end of the records of ``first`` or ``second`` that differ. Compares roots
    and descends into what differs only."""
    top = nodes.groupBy("replica", "name").agg(F.max_by("hash", "level").alias("hash"), F.max("level").alias("level"))
    top = written(top, "roots")
    levels = forest(top, fan)
    side = lambda df, r: df.where(F.col("replica") == r)
    bad = None
    for d, level in enumerate(reversed(levels)):
        if bad is not None:
            level = level.join(bad, F.shiftright(level["node"], 4 if d > 1 else 64) == bad["up"] if d > 1 else F.lit(True), "left_semi")
        bad = _differ(side(level, first), side(level, second), ["node"]).withColumnRenamed("node", "up")
        bad = written(bad, "differing")
        if not bad.limit(1).count():
            return nodes.where("false").select("name", "node", "start", "end")
    depth = len(levels) - 1
    at = F.conv(F.substring(F.sha2("name", 256), 1, 15), 16, 10).cast("long")
    here = top.withColumn("up", F.shiftright(at, 60 - 4 * depth) if depth else F.lit(0).cast("long")).join(bad, "up", "left_semi")
    files = _differ(side(here, first), side(here, second), ["name"])
    wrong = written(files, "differing-files")
    inside = nodes.join(wrong, "name", "left_semi")
    highest = inside.agg(F.max("level")).first()[0] or 0
    found = None
    for lv in range(highest, -1, -1):
        level = inside.where(F.col("level") == lv)
        if found is not None:
            # A file's tree may be lower than the highest: its root comes in at its own level.
            own = top.select("name", "level").groupBy("name").agg(F.max("level").alias("root"))
            level = level.join(own, "name").withColumn("up", F.floor(F.col("node") / fan))
            level = level.join(found.withColumnRenamed("node", "up").withColumn("hit", F.lit(True)), ["name", "up"], "left").where((F.col("root") == lv) | F.col("hit"))
        found = written(_differ(side(level, first), side(level, second), ["name", "node"]), "differing-nodes")
    span = nodes.where("level = 0").groupBy("name", "node").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return found.join(span, ["name", "node"])


def damage_some(key: str, raw: bytes, member: bytes) -> bytes:
    """What the audited copy of the query holds, by the first digit of the id's SHA-256. 0: another first
    byte of the body, packed anew. 1: a bit of the member's header flipped, which unpacking ignores.
    2: a bit in the middle of the packed data. 3: a bit of the checksum."""
    digit = hashlib.sha256(key.encode()).hexdigest()[0]
    if digit == "0":
        at = raw.index(b"\r\n\r\n") + 4
        return packed(raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :])
    at = {"1": 4, "2": 10 + (len(member) - 18) // 2, "3": len(member) - 8}.get(digit)
    return member if at is None else member[:at] + bytes([member[at] ^ 16]) + member[at + 1 :]


def fixity_report(pages: DataFrame) -> DataFrame:
    """op4: writes all pages as WARC files with a damaged copy, audits the replicas, and returns for
    each record page_id, n_bytes and record_sha256 (unpacked), copy_sha256 (null where the copy's
    can't be unpacked) and damaged (the audit's finding about the stored bytes)."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    made = write_warc(pages, folder, damage_some)
    files = made.select(F.lit("original").alias("replica"), "name", "path").unionByName(made.select(F.lit("copy").alias("replica"), "name", F.col("copy").alias("path")))
    nodes = written(file_trees(files, folder), "nodes")
    found = audit(nodes).select("name", "node", F.lit(True).alias("found"))
    leaves = nodes.where("level = 0")
    of = lambda replica, column: F.max(F.when(F.col("replica") == replica, F.col(column)))
    pairs = leaves.groupBy("name", "node").agg(
        of("original", "id").alias("id"), of("original", "size").alias("n_bytes"), of("original", "content").alias("record_sha256"), of("copy", "content").alias("copy_sha256")
    )
    out = pairs.join(found, ["name", "node"], "left")
    return out.select(F.nullif("id", F.lit("")).cast("long").alias("page_id"), "n_bytes", "record_sha256", "copy_sha256", F.coalesce("found", F.lit(False)).alias("damaged"))


ORACLE = """
WITH r AS (
  SELECT page_id, coalesce(CAST(page_id AS VARCHAR), '') AS key, coalesce(html, '') AS body,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:vecmill:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10)
    || 'WARC-Date: 2026-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
    || 'Content-Length: ' || CAST(octet_length(CAST(encode(coalesce(html, '')) AS BLOB)) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) AS head
  FROM pages),
s AS (
  SELECT page_id, substr(sha256(key), 1, 1) AS rot, head || body || chr(13) || chr(10) || chr(13) || chr(10) AS rec,
    head || chr(CAST(xor(ascii(substr(body || chr(13), 1, 1)), 1) AS INTEGER)) || substr(body || chr(13), 2) || chr(10) || chr(13) || chr(10) AS hurt
  FROM r)
SELECT page_id, CAST(octet_length(encode(rec)) AS BIGINT) AS n_bytes, sha256(rec) AS record_sha256,
  CASE rot WHEN '0' THEN sha256(hurt) WHEN '2' THEN NULL WHEN '3' THEN NULL ELSE sha256(rec) END AS copy_sha256, rot IN ('0', '1', '2', '3') AS damaged
FROM s
"""
