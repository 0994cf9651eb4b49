"""Scalar ranking, vector and time functions as Column expressions; vectors are arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either norm is 0. Both are bound as a lambda's variable, so they are computed once for each row."""

    def of(pair: Column) -> Column:
        x, y = pair["a"], pair["b"]
        parts = F.struct(dot(x, y).alias("dot"), (norm(x) * norm(y)).alias("size"))
        return F.element_at(F.transform(F.array(parts), lambda p: F.when(p["size"] == 0, 0.0).otherwise(p["dot"] / p["size"])), 1)

    return F.element_at(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), of), 1)


def sign_words(v: Column, dims: int) -> Column:
    """Sign bits (value > 0), 32 to a long."""
    words = []
    for w in range(0, dims, 32):
        bits = [F.when(F.element_at(v, i + 1) > 0, F.lit(1 << (i - w))).otherwise(F.lit(0)).cast("long") for i in range(w, min(dims, w + 32))]
        total = bits[0]
        for b in bits[1:]:
            total = total.bitwiseOR(b)
        words.append(total)
    return F.array(*words)


def hamming(a: Column, b: Column) -> Column:
    """Number of bits in which two arrays of words differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def downrank(score: Column, weight: Column) -> Column:
    """Lowers a score by a weight within [0.05, 1], whatever its sign."""
    w = F.greatest(F.lit(0.05), F.least(F.lit(1.0), weight))
    return F.when(score >= 0, score * w).otherwise(score / w)


def uprank(score: Column, factor: Column) -> Column:
    """Raises a score by a factor within [1, 3], whatever its sign."""
    f = F.greatest(F.lit(1.0), F.least(F.lit(3.0), factor))
    return F.when(score >= 0, score * f).otherwise(score / f)


def weighted(a: Column, b: Column, w: float) -> Column:
    return w * a + (1 - w) * b


def risk(callers: Column, modules: Column) -> Column:
    return F.when((callers > 1000) | (modules > 20), "CRITICAL").when((callers > 500) | (modules > 10), "HIGH").when((callers > 100) | (modules > 5), "MEDIUM").otherwise("LOW")


#: Parts of a module's path that make it infrastructure, and calls from which fan-in and fan-out count as high (fixed values).
INFRASTRUCTURE = ("test", "mock", "fixture", "script", ".github", "ci", "spec", "bench", "example", "third_party", "third-party", "vendor")
HIGH_IN, HIGH_OUT = 25, 30


def layer(name: Column, fan_in: Column, fan_out: Column) -> Column:
    """Architectural layer by the module's path and by the ratio of incoming to all calls."""
    ratio, low = fan_in / (fan_in + fan_out), F.lower(name)
    return (
        F.when(low.rlike("|".join(x.replace(".", "[.]") for x in INFRASTRUCTURE)), "Infrastructure")
        .when(F.contains(low, F.lit("/core/")) | F.startswith(low, F.lit("core/")), "Processing")
        .when(fan_in + fan_out == 0, "Infrastructure")
        .when((fan_in >= HIGH_IN) & (fan_out >= HIGH_OUT), "Processing")
        .when(ratio >= 0.75, "Data")
        .when((fan_in < HIGH_IN) & (fan_out >= HIGH_OUT), "Interface")
        .when(ratio > 0.65, "Data")
        .when(ratio < 0.35, "Interface")
        .otherwise("Processing")
    )


def kind_signal(kind: Column) -> Column:
    """How much a symbol's kind says for it as a result."""
    return F.when(kind.isin("Function", "Method"), 1.0).when(kind.isin("Class", "Struct", "Enum", "Module"), 0.8).when(kind.isin("Interface", "Trait", "TypeAlias"), 0.6).when(kind.isin("Constant", "Field", "Variable"), 0.45).otherwise(0.35)


def symbol_signal(kind: Column, fan: Column, trivial: Column) -> Column:
    """0.65 of the kind's signal and 0.35 of the calls', which grow with their logarithm; 0.5 without a symbol."""
    calls = F.when(trivial, 0.0).otherwise(F.least(F.lit(4.0), F.log(fan + 1)) / 4)
    return F.when(kind.isNull(), 0.5).otherwise(0.65 * kind_signal(kind) + 0.35 * calls)


def chunk_weight(chunk_type: Column) -> Column:
    """Weight of a chunk's type: code before comments, comments before documents."""
    code = ("function", "method", "class", "struct", "module", "interface", "enum", "flow_if_else", "flow_try_catch", "flow_switch", "flow_loop", "flow_call_chain", "flow_error_path")
    return F.when(chunk_type.isin(*code), 1.0).when(chunk_type.isin("module_comment", "inter_symbol_gap", "imports_gap"), 0.92).when(chunk_type == "doc_chunk", 0.65).when(chunk_type == "config_chunk", 0.6).when(chunk_type.isin("constant", "variable", "field", "type_alias"), 0.9).otherwise(0.85)


def is_block(chunk_type: Column, lines: Column, least: int = 4) -> Column:
    blocks = ("function", "method", "class", "struct", "interface", "enum", "module", "flow_if_else", "flow_try_catch", "flow_switch", "flow_loop", "flow_call_chain", "flow_error_path")
    return (lines >= max(2, least)) & chunk_type.isin(*blocks)


def normalised(v: Column) -> Column:
    """``v`` at unit length; the norm counts as 1e-12 at least."""
    size = F.greatest(norm(v), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / size)


def mean_vector(vectors: Column) -> Column:
    """Mean of an array of vectors of one length, null without any."""
    total = F.aggregate(F.slice(vectors, F.lit(2), F.greatest(F.lit(0), F.size(vectors) - 1)), F.transform(F.element_at(vectors, 1), lambda x: x.cast("double")), lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b.cast("double")))
    return F.when(F.size(vectors) > 0, F.transform(total, lambda x: x / F.size(vectors)))


def quantised(v: Column, scale: Column) -> Column:
    """Whole numbers from -127 to 127 by one scale for all vectors."""
    return F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.rint(x.cast("double") / scale).cast("int"))))


def in_utc(rows: DataFrame, ts: str) -> Column:
    """Column ``ts`` of ``rows`` as a point in time: a time without a zone counts as UTC, whatever the session's zone and its clock changes."""
    if not isinstance(rows.schema[ts].dataType, TimestampNTZType):
        return F.col(ts)
    since = (F.col(ts) - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")).cast("interval second")
    return F.timestamp_micros((since.cast("decimal(24, 6)") * 1_000_000).cast("long"))


def epoch_ms(rows: DataFrame, ts: str) -> Column:
    """Milliseconds since 1970 of column ``ts`` of ``rows`` as DuckDB's epoch_ms gives them: the nearest, halves away from zero."""
    us = F.unix_micros(in_utc(rows, ts))
    return F.call_function("div", us + F.when(us < 0, -500).otherwise(500), F.lit(1000))
