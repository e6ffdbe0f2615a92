"""Archive integrity: manifest against files, canonical input, signature."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions import scalars as S

MANIFEST = "integrity.manifest.json"


def hashed(files: DataFrame) -> DataFrame:
    """(path, hash) of files (path, content)."""
    return files.select("path", S.content_hash("content").alias("hash"))


def reconcile(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, outcome) of a full join of manifest and files (path, hash): ok, mismatch, missing or untracked. The manifest itself is not tracked."""
    m, f = manifest.select("path", F.col("hash").alias("expected")), files.filter(F.col("path") != MANIFEST).select("path", F.col("hash").alias("actual"))
    outcome = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "untracked").when(F.col("expected") != F.col("actual"), "mismatch").otherwise("ok")
    return m.join(f, "path", "full_outer").select("path", outcome.alias("outcome"))


def outcome_counts(rows: DataFrame, column: str = "outcome") -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def canonical_input(manifest: DataFrame, *keys: str) -> DataFrame:
    """The sorted path:hash lines of each manifest (``keys``; none: of all rows) as one string.

    A manifest is the size of one archive's list of files, and one row holds it.
    """
    lines = F.array_sort(F.collect_list(F.struct("path", "hash")))
    return manifest.groupBy(*keys).agg(F.array_join(F.transform(lines, lambda e: F.concat(e["path"], F.lit(":"), e["hash"], F.lit("\n"))), "").alias("canonical"))


_MANIFEST = "version string, algorithm string, signature string, files map<string,string>"


def verify_archives(hashes: DataFrame, public_key: bytes) -> DataFrame:
    """(archive, version, outcome, path) of each archive, from its files (archive, path, hash, content of the manifest).

    The outcome is the first that applies: unreadable, no manifest, manifest (which is no JSON object), algorithm,
    signature, missing, mismatch, untracked, ok. path is the first file, in order, that is missing, another or not listed.
    """
    own = F.from_json(F.col("content").cast("string"), _MANIFEST)
    listed = hashes.filter(F.col("path") == MANIFEST).select("archive", own.alias("m")).select("archive", "m.*")
    expected = listed.select("archive", F.explode("files").alias("path", "expected"))
    actual = hashes.filter(F.col("path").isNotNull() & (F.col("path") != MANIFEST)).select("archive", "path", F.col("hash").alias("actual"))
    kind = F.when(F.col("actual").isNull(), 0).when(F.col("expected").isNull(), 2).when(F.col("actual") != F.col("expected"), 1)
    wrong = expected.join(actual, ["archive", "path"], "full_outer").withColumn("kind", kind).groupBy("archive").agg(F.min(F.when(F.col("kind").isNotNull(), F.struct("kind", "path"))).alias("wrong"))
    lines = F.array_sort(F.map_entries("files"))
    canonical = F.array_join(F.transform(lines, lambda e: F.concat(e["key"], F.lit(":"), e["value"], F.lit("\n"))), "")
    signed = verify_signature(listed.select("archive", "version", "algorithm", F.col("files").isNull().alias("broken"), canonical.alias("canonical"), "signature"), public_key)
    archives = hashes.groupBy("archive").agg(F.bool_or(F.col("path").isNull()).alias("cut")).join(signed, "archive", "left").join(wrong, "archive", "left")
    found = F.when(F.col("wrong.kind") == 0, "missing").when(F.col("wrong.kind") == 1, "mismatch").when(F.col("wrong.kind") == 2, "untracked")
    outcome = F.when(F.col("cut"), "unreadable").when(F.col("broken").isNull(), "no manifest").when(F.col("broken"), "manifest").when(~F.col("algorithm").eqNullSafe(F.lit("EdDSA")), "algorithm").when(~F.col("verified"), "signature")
    outcome = outcome.otherwise(F.coalesce(found, F.lit("ok")))
    return archives.select("archive", "version", outcome.alias("outcome"), F.when(outcome.isin("missing", "mismatch", "untracked"), F.col("wrong.path")).alias("path"))


_P, _L = 2**255 - 19, 2**252 + 27742317777372353535851937790883648493
_D = -121665 * pow(121666, -1, _P) % _P


def _recovered(encoded: bytes) -> tuple[int, int] | None:
    """The point of the curve that 32 bytes stand for, if there is one."""
    number = int.from_bytes(encoded, "little")
    sign, y = number >> 255, number & ((1 << 255) - 1)
    if len(encoded) != 32 or y >= _P:
        return None
    square = (y * y - 1) * pow(_D * y * y + 1, -1, _P) % _P
    x = pow(square, (_P + 3) // 8, _P)
    if (x * x - square) % _P:
        x = x * pow(2, (_P - 1) // 4, _P) % _P
    if (x * x - square) % _P or (x == 0 and sign):
        return None
    return (_P - x if x & 1 != sign else x), y


def _added(p: tuple, q: tuple) -> tuple:
    """The sum of two points in extended coordinates."""
    a, b = (p[1] - p[0]) * (q[1] - q[0]), (p[1] + p[0]) * (q[1] + q[0])
    c, d = 2 * _D * p[3] * q[3], 2 * p[2] * q[2]
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % _P, g * h % _P, f * g % _P, e * h % _P


def _times(n: int, point: tuple[int, int]) -> tuple:
    out, power = (0, 1, 1, 0), (*point, 1, point[0] * point[1] % _P)
    while n:
        if n & 1:
            out = _added(out, power)
        power, n = _added(power, power), n >> 1
    return out


def ed25519_valid(public_key: bytes, signature: bytes, message: bytes) -> bool:
    """Whether a signature holds, by the equation of RFC 8032. It works on public values only, so it need not be constant-time."""
    base, key, r = _recovered((4 * pow(5, -1, _P) % _P).to_bytes(32, "little")), _recovered(public_key), _recovered(signature[:32])
    s = int.from_bytes(signature[32:], "little")
    if len(signature) != 64 or key is None or r is None or s >= _L:
        return False
    k = int.from_bytes(hashlib.sha512(signature[:32] + public_key + message).digest(), "little") % _L
    left, right = _times(s, base), _added((*r, 1, r[0] * r[1] % _P), _times(k, key))
    return (left[0] * right[2] - right[0] * left[2]) % _P == 0 and (left[1] * right[2] - right[1] * left[2]) % _P == 0


def verify_signature(rows: DataFrame, public_key: bytes) -> DataFrame:
    """``rows`` (canonical, signature in hex, algorithm) with verified: an Ed25519 check. A signature that is null, no hex or of another algorithm does not hold."""
    schema = rows.select("*", F.lit(None).cast("boolean").alias("verified")).schema

    def check(text: str | None, signature: str | None, algorithm: str | None) -> bool:
        try:
            return algorithm == "EdDSA" and ed25519_valid(public_key, bytes.fromhex(signature or ""), (text or "").encode())
        except ValueError:
            return False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [*map(check, *(batch.column(c).to_pylist() for c in ("canonical", "signature", "algorithm")))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.bool_())], names=schema.names)

    return rows.mapInArrow(run, schema)
