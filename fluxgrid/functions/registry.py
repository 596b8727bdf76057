"""The kinds of traces by name, which a caller can extend; `traces.all_kinds` computes all that are here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from fluxgrid.operators import traces

TraceKind = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]
#: (mean trace, surround's trace, denoised trace) to (roi, frame, v) by kind.
TRACES: dict[str, TraceKind] = {
    "mean": lambda mean, around, denoised: mean,
    "mean denoised": lambda mean, around, denoised: denoised,
    "mean corrected": lambda mean, around, denoised: traces.corrected(mean, around),
    "mean denoised corrected": lambda mean, around, denoised: traces.corrected(denoised, around),
    "relative": lambda mean, around, denoised: traces.relative(mean),
    "relative denoised": lambda mean, around, denoised: traces.relative(denoised),
    "relative corrected": lambda mean, around, denoised: traces.relative(traces.corrected(mean, around)),
    "relative denoised corrected": lambda mean, around, denoised: traces.relative(traces.corrected(denoised, around)),
    "surround": lambda mean, around, denoised: around,
}


def register_trace(kind: str, build: TraceKind) -> None:
    if kind in TRACES:
        raise ValueError(f"trace kind {kind} exists")
    TRACES[kind] = build
