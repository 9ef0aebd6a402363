"""Segments of ticks and bars as binary values: a raw form, and a compressed form of separate streams.

A blob is one segment of one series (an hour of ticks, a segment of bars), so a group is of bounded size. The first byte tells the forms
apart. The compressed form keeps time, price, volume and side, as the differences and runs of operators.codec under zstandard, with a
trained dictionary if one is given; prices and volumes come back as multiples of their digits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom import types
from marketloom.operators.codec import vbyte_bytes, vbyte_values

RAW, COMPRESSED = 0, 1
DICTIONARY_BYTES = 102_400
TICK = np.dtype([(c, "<i8" if c in ("time_ms", "received_ms", "flags") else "<f8") for c in ("time_ms", "received_ms", "ask", "bid", "last", "volume", "flags")])
BAR = np.dtype([(c, "<i8" if c in ("time_ms", "spread", "tick_volume") else "<f8") for c in (
    "time_ms", "open", "high", "low", "close", "volume", "quote_volume", "buy_volume", "buy_quote_volume", "spread", "tick_volume")])
KINDS = {"ticks": TICK, "bars": BAR}


def zigzag(v: np.ndarray) -> np.ndarray:
    return (v << 1 ^ v >> 63).astype(np.int64)


def unzigzag(z: np.ndarray) -> np.ndarray:
    return (z >> 1) ^ -(z & 1)


def compress(data: bytes, level: int = 3, dictionary: bytes | None = None) -> bytes:
    kept = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=level, dict_data=kept).compress(data)


def decompress(data: bytes, dictionary: bytes | None = None) -> bytes:
    kept = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdDecompressor(dict_data=kept).decompress(data)


def raw(table: np.ndarray) -> bytes:
    return bytes([RAW]) + vbyte_bytes(np.array([len(table)])) + table.tobytes()


def _count(blob: bytes) -> tuple[int, int]:
    """The number of rows, and where it ends."""
    end = 1
    while blob[end] & 128:
        end += 1
    return int(vbyte_values(blob[1 : end + 1])[0]), end + 1


def unraw(blob: bytes, kind: np.dtype) -> np.ndarray:
    n, at = _count(blob)
    return np.frombuffer(blob, kind, n, at)


def _stream(values: np.ndarray) -> bytes:
    data = vbyte_bytes(values)
    return len(data).to_bytes(4, "little") + data


def packed_ticks(t: np.ndarray, price_digits: int, volume_digits: int, dictionary: bytes | None = None) -> bytes:
    """Time as differences that mustn't fall, price as zigzag differences, volume as scaled integers, side and updates as flags."""
    steps = np.diff(t["time_ms"], prepend=t["time_ms"][:1] * 0)
    if len(t) and (steps[1:] < 0).any():
        raise ValueError("times fall")
    whole = lambda c, d: np.floor(np.abs(t[c]) * 10.0**d + 0.5).astype(np.int64) * np.sign(t[c]).astype(np.int64)
    prices = zigzag(np.diff(whole("last", price_digits), prepend=0))
    body = b"".join(map(_stream, (steps, prices, zigzag(whole("volume", volume_digits)), t["flags"])))
    head = bytes([COMPRESSED]) + vbyte_bytes(np.array([len(t)])) + bytes([price_digits, volume_digits])
    return head + compress(body, dictionary=dictionary)


def unpacked_ticks(blob: bytes, dictionary: bytes | None = None) -> np.ndarray:
    n, at = _count(blob)
    digits, body, place, parts = (blob[at], blob[at + 1]), decompress(blob[at + 2 :], dictionary), 0, []
    for _ in range(4):
        size = int.from_bytes(body[place : place + 4], "little")
        parts.append(vbyte_values(body[place + 4 : place + 4 + size]))
        place += 4 + size
    out = np.zeros(n, TICK)
    out["time_ms"] = np.cumsum(parts[0])
    out["last"] = np.cumsum(unzigzag(parts[1])) / 10.0 ** digits[0]
    out["volume"] = unzigzag(parts[2]) / 10.0 ** digits[1]
    out["flags"] = parts[3]
    return out


def num_samples(blob: bytes) -> int:
    """The row count from the head alone."""
    return _count(blob)[0]


def serialize(rows: DataFrame, keys: Sequence[str], kind: str, config: types.TickCodecConfig | types.BarCodecConfig, dictionary: bytes | None = None) -> DataFrame:
    """keys, blob. STORE_RAW_BINARY chooses the raw form; bars have that form only; the compressed form needs TRADE_BASED and ENABLE_TICK_FLAGS."""
    form, names = KINDS[kind], list(KINDS[kind].names)
    plain = kind == "bars" or config.has(types.TICKS_RAW_BINARY)
    if kind == "bars" and not config.has(types.STORE_RAW_BINARY):
        raise ValueError("bars are kept in the raw form")
    if not plain and not (config.has(types.TRADE_BASED) and config.has(types.ENABLE_TICK_FLAGS)):
        raise ValueError("the compressed form needs trade ticks with flags")

    def one(key: tuple, parts: list[pd.DataFrame]) -> tuple:
        pdf = pd.concat(parts) if len(parts) > 1 else parts[0]
        table = np.zeros(len(pdf), form)
        for c in names:
            table[c] = pdf[c].to_numpy()
        return *key, raw(table) if plain else packed_ticks(table, config.price_digits, config.volume_digits, dictionary)

    def all_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by key; the rows of one key are held at a time."""
        now, parts, done = None, [], []
        for pdf in batches:
            ids = pdf[list(keys)].to_numpy()
            edges = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1).tolist(), len(pdf)]
            for a, z in zip(edges, edges[1:]):
                if a == z:
                    continue
                key = tuple(pdf[c].iat[a] for c in keys)
                if key != now:
                    done += [one(now, parts)] if parts else []
                    now, parts = key, []
                parts.append(pdf.iloc[a:z])
            if len(done) > 500:
                yield pd.DataFrame(done, columns=[*keys, "blob"])
                done = []
        done += [one(now, parts)] if parts else []
        if done:
            yield pd.DataFrame(done, columns=[*keys, "blob"])

    schema = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in keys)
    order = [c for c in ("seq",) if c in rows.columns]
    out = rows.select(*keys, *(c for c in names if c not in keys), *order)
    return out.repartition(*keys).sortWithinPartitions(*keys, "time_ms", *order).mapInPandas(all_, f"{schema}, blob binary")


def deserialize(blobs: DataFrame, keys: Sequence[str], kind: str, dictionary: bytes | None = None) -> DataFrame:
    """Rows of each blob; the first byte chooses the form."""
    form, kinds = KINDS[kind], dict(blobs.dtypes)
    columns = ", ".join(f"{c} {'long' if form[c].kind == 'i' else 'double'}" for c in form.names)

    def all_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables, keyed = [], []

        def joined() -> pd.DataFrame:
            whole, sizes = np.concatenate(tables), [len(t) for t in tables]
            out = {k: np.repeat(np.array([x[i] for x in keyed]), sizes) for i, k in enumerate(keys)} | {c: whole[c] for c in form.names}
            tables.clear()
            keyed.clear()
            return pd.DataFrame(out)

        for pdf in batches:
            for row in pdf.to_dict("records"):
                blob = bytes(row["blob"])
                if blob[0] not in (RAW, COMPRESSED):
                    raise ValueError("no known signature")
                tables.append(unraw(blob, form) if blob[0] == RAW else unpacked_ticks(blob, dictionary))
                keyed.append([row[k] for k in keys])
                if sum(map(len, tables)) > 50_000:
                    yield joined()
            if tables:
                yield joined()

    return blobs.select(*keys, "blob").mapInPandas(all_, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + columns)


def train_dictionary(blobs: DataFrame, size: int = DICTIONARY_BYTES, samples: int = 2000) -> bytes:
    """A dictionary from at most `samples` values of the column blob, those of the smallest hashes."""
    rows = blobs.select("blob").orderBy(F.xxhash64("blob")).limit(samples).collect()
    return zstandard.train_dictionary(size, [bytes(r.blob) for r in rows]).as_bytes()
