"""Column -> Column functions on boxes, vectors, ranks and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafgrain.functions.text import normalize_ws
from leafgrain.schemas import RRF_K


def valid_bbox(box: Column) -> Column:
    """Four finite numbers with ordered corners."""
    finite = F.forall(
        box, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    )
    ordered = (F.get(box, F.lit(0)) <= F.get(box, F.lit(2))) & (
        F.get(box, F.lit(1)) <= F.get(box, F.lit(3))
    )
    return (F.size(box) == 4) & finite & ordered


def bbox_overlap_ratio(inner: Column, outer: Column) -> Column:
    """Share of the inner box that the outer box covers."""
    width = F.least(inner[2], outer[2]) - F.greatest(inner[0], outer[0])
    height = F.least(inner[3], outer[3]) - F.greatest(inner[1], outer[1])
    area = (inner[2] - inner[0]) * (inner[3] - inner[1])
    return F.when((width <= 0) | (height <= 0) | (area <= 0), F.lit(0.0)).otherwise(
        width * height / area
    )


def vertical_overlap(first: Column, second: Column) -> Column:
    return F.greatest(
        F.lit(0.0), F.least(first[3], second[3]) - F.greatest(first[1], second[1])
    )


def _dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def cosine_similarity(left: Column, right: Column) -> Column:
    """Cosine in double precision; null on length mismatch, empty or zero vectors."""
    norms = F.sqrt(_dot(left, left)) * F.sqrt(_dot(right, right))
    defined = (F.size(left) == F.size(right)) & (F.size(left) > 0) & (norms > 0)
    return F.when(defined, _dot(left, right) / norms)


def rrf(rank: Column, k: int = RRF_K) -> Column:
    return F.coalesce(F.lit(1.0) / (rank + k), F.lit(0.0))


def best_rank(first: Column, second: Column) -> Column:
    return F.coalesce(F.least(first, second), F.lit(10**9))


def quality_score(pages: Column, coverage: Column, needs_layout: Column) -> Column:
    penalty = F.when(needs_layout, 0.15).otherwise(0.0)
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), coverage - penalty))
    return F.when(pages == 0, F.lit(0.0)).otherwise(clamped)


def age_exceeds(at: Column, now: Column, seconds: int) -> Column:
    """True when a time is missing or older than the cutoff."""
    return at.isNull() | (at < now - F.expr(f"INTERVAL {int(seconds)} SECONDS"))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Six-decimal ratio; 1 when there is nothing to count."""
    return F.when(denominator == 0, F.lit(1.0)).otherwise(F.round(numerator / denominator, 6))


def format_embedding_text(text: Column, model: Column, kind: str) -> Column:
    """Collapse whitespace; E5-style models get a role prefix exactly once."""
    clean = normalize_ws(text)
    prefix = f"{kind}: "
    needs = F.lower(F.trim(model)).contains("e5") & ~F.lower(clean).startswith(prefix)
    return F.when(needs, F.concat(F.lit(prefix), clean)).otherwise(clean)
