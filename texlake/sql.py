"""The functions under SQL names.

A function is a temporary SQL function around a kernel (``tx_kernel_…``), so that SQL has the gates that columns have: rows
that a kernel would leave as they are get null there and never reach Python. What is native as a column is native in SQL.
The text of an expression comes from Spark's own analysis of it, which a session of this process (not a remote one) gives.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .kernels import display, encoding, findings, fixing, mend, options, plain, tokens, transport, write
from .plans import gates
from .plans.kernels import kernel

_SIGNS = lambda c: c.rlike(r"[\\$^_{}%]") | c.rlike(gates.MATH_SIGNS)

#: name: (kernel, its type, gate). What the gate excludes stays as it is, is false, or is an empty array.
_GATED: dict[str, tuple[Callable, str, Callable[[Column], Column]]] = {
    "repair": (mend.repair, "string", gates.repair),
    "repair_deep": (mend.repair, "string", gates.repair),
    "normalize": (display.normalize, "string", gates.normalize),
    "normalize_delimiters": (display.normalize_delimiters, "string", gates.backslash),
    "escape_currency": (display.escape_currency, "string", gates.money),
    "canonicalize": (write.canonicalize, "string", gates.fix),
    "fix": (fixing.fix, "string", gates.fix),
    "fix_no_chemistry": (partial(fixing.fix, chemistry=False), "string", gates.fix),
    "needs_fix": (fixing.needs_fix, "boolean", lambda c: gates.fix(c) | c.contains("%")),
    "normalize_option_text": (options.normalize_option_text, "string", gates.fix),
    "fix_mojibake": (encoding.fix_mojibake, "string", gates.encoding),
    "unescape_html": (encoding.unescape_html, "string", lambda c: c.contains("&")),
    "escape_latex_for_json": (transport.escape_latex_for_json, "string", gates.backslash),
    "contains_math": (tokens.contains_math, "boolean", gates.segments),
    "currency_spans": (tx._spans, f"array<{tx.SPAN}>", gates.money),
    "audit": (tx._findings, f"array<{tx.FINDING}>", gates.audit),
    "audit_kinds": (findings.audit_kinds, "array<string>", gates.audit),
    "to_plain_text": (plain.to_plain, "string", gates.plain),
    "to_plain_pdf": (partial(plain.to_plain, style="pdf"), "string", gates.plain),
    "to_plain_tts": (partial(plain.to_plain, style="tts"), "string", gates.spoken),
    **{name: (f, "string", _SIGNS) for name, f in tx.STEPS.items()},
}
_NATIVE: dict[str, Callable[[Column], Column]] = {
    "repair_read": partial(tx.repair, guess_whitespace=False),
    "strip_orphan_delimiters": tx.strip_orphan_delimiters,
    "normalize_homoglyphs": tx.normalize_homoglyphs,
    "is_plain_prose": tx.is_plain_prose,
    "has_raw_math": tx.has_raw_math,
    "is_url_or_path": tx.is_url_or_path,
    "is_non_content_key": tx.is_non_content_key,
    "is_not_rendered_key": tx.is_not_rendered_key,
}


def _call(f, text):
    return None if text is None else f(text)


def _otherwise(name: str, kind: str, folded: str) -> str:
    """What rows get that the gate keeps from the kernel."""
    if name == "segment":
        whole = "array(named_struct('kind', 'text', 'display', false, 'value', x, 'raw', x))"
        return f"case when x <> '' then cast({whole} as {kind}) else cast(array() as {kind}) end"
    if name == "to_plain_compare":
        return folded
    return "x" if kind == "string" else "false" if kind == "boolean" else f"cast(array() as {kind})"


def register(spark: SparkSession) -> list[str]:
    """Register all functions in the session; gives their names."""
    gated = {**_GATED, "segment": (tx._segments, f"array<{tx.SEGMENT}>", gates.segments), "to_plain_compare": (partial(plain.to_plain, style="compare"), "string", gates.answer)}
    empty = spark.range(1).select(F.lit("").alias("x"))

    def text_of(c: Column) -> tuple[str, str]:
        found = empty.select(c.alias("y"))
        return found._jdf.queryExecution().analyzed().expressions().head().child().sql(), found.schema["y"].dataType.simpleString()

    def define(name: str, said: str, kind: str) -> None:
        spark.sql(f"create or replace temporary function tx_{name}(x string) returns {kind} return {said}")

    folded, _ = text_of(tx.folded_answer(F.col("x")))
    for name, (f, kind, gate) in gated.items():
        spark.udf.register(f"tx_kernel_{name}", kernel(partial(_call, f), kind))
        holds, _ = text_of(gate(F.col("x")))
        other = _otherwise(name, kind, folded)
        define(name, f"case when {holds} then tx_kernel_{name}(case when {holds} then x end) else {other} end", kind)
    for name, native in _NATIVE.items():
        define(name, *text_of(native(F.col("x"))))
    return sorted(f"tx_{name}" for name in (*gated, *_NATIVE))
