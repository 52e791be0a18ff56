"""The 13 axes of a site's token-expert graph: how committed, alike and spread its tokens' distributions are.

A site is a matrix of tokens by experts, flat in its row. Axes work on Arrow batches of whole rows, as singular values are
no column expression; nothing is gathered beyond a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship

#: Names of the axes, in their order.
AXES = ("commitment", "entropy", "top1_mass", "top4_mass", "top12_margin", "consensus", "dispersion", "effective_rank", "stable_rank", "mutual_information", "top_occupancy", "occupancy_entropy", "support_union")
TINY = 1e-12


def entropy(p: np.ndarray) -> np.ndarray:
    return -(p * np.log(np.maximum(p, TINY))).sum(-1)


def axes(sites: np.ndarray, top: int = 4) -> np.ndarray:
    """Rows of sites (tokens by experts, non-negative) as rows of the 13 axes."""
    p = sites / np.maximum(sites.sum(-1, keepdims=True), TINY)
    n, tokens, experts = p.shape
    order = np.argsort(-p, axis=-1, kind="stable")
    ranked = np.take_along_axis(p, order, -1)
    own = entropy(p).mean(1)
    a, b = np.triu_indices(tokens, 1)
    low, high = np.minimum(p[:, a], p[:, b]).sum(-1), np.maximum(p[:, a], p[:, b]).sum(-1)
    apart = np.sqrt(np.clip(1 - np.sqrt(p[:, a] * p[:, b]).sum(-1), 0, 1))
    values = np.linalg.svd(p, compute_uv=False)
    mass = values / np.maximum(values.sum(-1, keepdims=True), TINY)
    used = np.zeros((n, experts))
    np.add.at(used, (np.repeat(np.arange(n), tokens * top), order[..., :top].reshape(-1)), 1)
    share, full = used / (tokens * top), np.log(experts)
    return np.stack(
        (
            1 - own / full, own / full, ranked[..., 0].mean(1), ranked[..., :top].sum(-1).mean(1), (ranked[..., 0] - ranked[..., 1]).mean(1),
            (low / np.maximum(high, TINY)).mean(1), apart.mean(1), np.exp(entropy(mass)), (values**2).sum(-1) / np.maximum(values[:, 0] ** 2, TINY),
            (entropy(p.mean(1)) - own) / full, share.max(-1), entropy(share) / full, (used > 0).sum(-1) / experts,
        ),
        -1,
    )


def graph_block(df: DataFrame, ident: str, site: str, tokens: int, experts: int, top: int = 4) -> DataFrame:
    """(id, 13 axes) of each row whose site has tokens times experts finite entries; negative ones count as zero."""
    ship(df.sparkSession)
    whole = (F.size(site) == tokens * experts) & ~F.exists(site, lambda x: x.isNull() | F.isnan(x.cast("double")))

    def run(batches):
        for b in batches:
            x = np.maximum(b.column(1).flatten().to_numpy().reshape(-1, tokens, experts), 0)
            out = axes(x, top)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(out[:, k]) for k in range(len(AXES)))], names=["id", *AXES])

    kind = df.schema[ident].dataType.simpleString()
    rows = df.where(whole).select(ident, F.col(site).cast("array<double>"))
    return rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"{a} double" for a in AXES)).withColumnRenamed("id", ident)
