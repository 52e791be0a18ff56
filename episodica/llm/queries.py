"""Registry of the training-data queries and their SQL."""

from __future__ import annotations

from . import bpe, centroids, decontam, digest, jaccard, lattice, packing, periods, pii, quality, suffix, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_packing": packing.op2_packing,
    "op3_pii": pii.op3_pii,
    "op4_warc": warc.op4_warc,
    "op5_jaccard": jaccard.op5_jaccard,
    "op6_digest": digest.op6_digest,
    "op7_bpe": bpe.op7_bpe,
    "op8_suffix": suffix.op8_suffix,
    "op9_lattice": lattice.op9_lattice,
    "op10_quality": quality.op10_quality,
    "op11_periods": periods.op11_periods,
    "op12_centroids": centroids.op12_centroids,
    "op13_decontamination": decontam.op13_decontamination,
}

SQL: dict[str, str] = {
    "op4_warc": warc.SQL,
    "op12_centroids": centroids.SQL,
    "op13_decontamination": decontam.SQL,
}
