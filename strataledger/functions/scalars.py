"""Scalar rules of the ledger as columns; all of them stay inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataledger.schema import HOT_BLOCKS, SIZE_CLASSES, VALUE_CLASSES


def segment(creation: Column, size: int = 50_000) -> Column:
    return (creation - creation % size).cast("int")


def epoch(creation: Column) -> Column:
    """Six uneven ranges of height."""
    starts = (0, 100_000, 300_000, 500_000, 600_000, 700_000)  # fixed values
    out = F.lit(0)
    for k, start in enumerate(starts):
        out = F.when(creation >= start, k).otherwise(out)
    return out.cast("int")


def block_epoch(creation: Column) -> Column:
    """Epochs of 100,000 blocks."""
    return F.floor(creation / 100_000).cast("int")


def is_op_return(script: Column) -> Column:
    """The script begins with 0x6a; an empty or null one does not."""
    return F.coalesce(F.substring(script, 1, 1) == F.lit(b"\x6a"), F.lit(False))


def size_class(size: Column, limits: Sequence[int] = SIZE_CLASSES) -> Column:
    """Index of the first limit that holds the payload; larger payloads are an error."""
    out = F.raise_error(F.concat(F.lit("no size class for "), size.cast("string"))).cast("int")
    for k in reversed(range(len(limits))):
        out = F.when(size <= limits[k], k).otherwise(out)
    return out


def right_closed(x: Column, edges: Sequence[float]) -> Column:
    """Bin k of (edges[k], edges[k + 1]]; null outside."""
    out = F.lit(None).cast("int")
    for k in reversed(range(len(edges) - 1)):
        inside = x > edges[k] if edges[k + 1] == float("inf") else (x > edges[k]) & (x <= edges[k + 1])
        out = F.when(inside, k).otherwise(out)
    return out


def left_closed(x: Column, edges: Sequence[float]) -> Column:
    """Bin k of [edges[k], edges[k + 1]); the last bin has no end; null below the first."""
    out = F.lit(None).cast("int")
    for k in range(len(edges) - 1):
        out = F.when(x >= edges[k], k).otherwise(out)
    return out


def value_class(value: Column) -> Column:
    """dust to whale, right-closed; null for 0."""
    out = F.lit(None).cast("string")
    low = 0
    for name, high in VALUE_CLASSES:
        out = F.when((value > low) & (value <= high) if high is not None else value > low, name).otherwise(out)
        low = high
    return out


def is_hot(duration: Column, event: Column, blocks: int = HOT_BLOCKS) -> Column:
    return (duration <= blocks) & event


def log_duration(duration: Column, event: Column, censored: float = 0.5) -> Column:
    """ln(duration), raised by a constant for outputs that are not spent yet."""
    return F.ln(duration.cast("double")) + F.when(event, 0.0).otherwise(censored)


def reversed_hex(raw: Column) -> Column:
    """A hash as it is shown: its bytes in reverse, as hex."""
    pairs = F.transform(F.sequence(F.lit(0), F.length(raw) - 1), lambda i: F.substring(F.hex(raw), 2 * i + 1, F.lit(2)))
    return F.when(F.length(raw) > 0, F.lower(F.array_join(F.reverse(pairs), ""))).otherwise("")


def outpoint_text(raw: Column, vout: Column) -> Column:
    return F.concat(reversed_hex(raw), F.lit(":"), vout.cast("string"))


def outpoint_bytes(raw: Column, vout: Column) -> Column:
    """Hash and index in little-endian bytes as one key of 36 bytes."""
    byte = lambda k: F.lpad(F.hex(F.shiftright(vout.cast("long"), 8 * k).bitwiseAND(F.lit(255))), 2, "0")
    return F.concat(raw, F.unhex(F.concat(*(byte(k) for k in range(4)))))


def pack_pointer(container: Column, version: Column, index: Column) -> Column:
    """2 bits of container, 16 of version, 46 of index in a long; negative from container 2 on."""
    return F.shiftleft(container.cast("long"), 62).bitwiseOR(F.shiftleft(version.cast("long"), 46)).bitwiseOR(index.cast("long"))


def unpack_pointer(pointer: Column) -> tuple[Column, Column, Column]:
    """Container, version and index."""
    return F.shiftrightunsigned(pointer, 62).cast("int"), F.shiftrightunsigned(pointer, 46).bitwiseAND(F.lit(0xFFFF)).cast("int"), pointer.bitwiseAND(F.lit((1 << 46) - 1))


def saturating_age(height: Column, insertion: Column) -> Column:
    return F.greatest(height - insertion, F.lit(0))


def si_format(x: Column) -> Column:
    """A whole number at three significant figures, half rounded up, without trailing zeros, and k, M, B or T.

    Whole arithmetic throughout, as engines differ in how they print halves.
    """
    div = lambda a, b: F.call_function("div", a, b)
    out = None
    for limit, mark in ((10**12, "T"), (10**9, "B"), (10**6, "M"), (10**3, "k"), (1, "")):
        text = None
        for size, places in ((100, 0), (10, 1), (1, 2)):
            scale = F.lit(10**places).cast("long")
            n = div(x.cast("long") * scale + F.lit(limit // 2), F.lit(limit).cast("long"))
            shown = n.cast("string")
            if places:
                tail = F.regexp_replace(F.concat(F.lit("."), F.lpad((n % scale).cast("string"), places, "0")), r"\.?0+$", "")
                shown = F.concat(div(n, scale).cast("string"), tail)
            text = F.when(x >= limit * size, shown) if text is None else text.when(x >= limit * size, shown)
        out = F.when(x >= limit, F.concat(text, F.lit(mark))) if out is None else out.when(x >= limit, F.concat(text, F.lit(mark)))
    return out.otherwise("0")


def rate_format(x: Column) -> Column:
    """A rate without decimals, and k, M, B or T."""
    out = None
    for limit, mark in ((1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "k")):
        text = F.format_string(f"%.0f{mark}", x / limit)
        out = F.when(x >= limit, text) if out is None else out.when(x >= limit, text)
    return out.otherwise(F.format_string("%.0f", x.cast("double")))


def time_format(nanoseconds: Column) -> Column:
    return F.format_string("%.4fs (%dns)", nanoseconds / 1e9, nanoseconds.cast("long"))


def version_file(container: Column, version: Column) -> Column:
    return F.format_string("cont_%d_v%05d.dat", container, version)


def version_of_file(name: Column) -> tuple[Column, Column]:
    return F.regexp_extract(name, r"cont_(\d+)_v(\d+)\.dat", 1).cast("int"), F.regexp_extract(name, r"cont_(\d+)_v(\d+)\.dat", 2).cast("int")


def bucket_count(n: Column) -> Column:
    """Buckets of a hash table for n entries at a load of 0.836: a power of two of groups of 15, less one."""
    # 0.836 and 15, the load and the group of the hash table.
    groups = F.floor((F.ceil(n / F.lit(0.836)) + 1) / 15)
    power = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(groups, F.lit(1)).cast("double"))))
    return F.when(n == 0, 0).when(n < 15, 29).otherwise(power * 15 - 1).cast("long")


def storage_decision(p: Column, hot: float, cold: float) -> Column:
    return F.when(p >= hot, "hot_storage").when(p <= cold, "cold_storage").otherwise("review")


def confidence(p: Column) -> Column:
    # The limits of high and medium confidence.
    return F.when((p >= 0.8) | (p <= 0.2), "high").when((p >= 0.6) | (p <= 0.4), "medium").otherwise("low")
