"""The queries of this subpackage, by name, and the SQL that states the same where SQL can."""

from __future__ import annotations

from . import centroids, decontaminate, secret_scan, urls, warc
from .ann import op1_ann
from .bpe import op4_bpe
from .centroids import op11_centroids
from .decontaminate import op6_decontaminate
from .licenses import op3_licenses
from .lm import op10_lm
from .quality import op2_quality
from .runs import op13_runs
from .secret_scan import op12_secrets
from .simhash import op9_simhash
from .toxicity import op8_toxicity
from .urls import op5_urls
from .warc import op7_warc

QUERIES = {
    "op1_ann": op1_ann,
    "op2_quality": op2_quality,
    "op3_licenses": op3_licenses,
    "op4_bpe": op4_bpe,
    "op5_urls": op5_urls,
    "op6_decontaminate": op6_decontaminate,
    "op7_warc": op7_warc,
    "op8_toxicity": op8_toxicity,
    "op9_simhash": op9_simhash,
    "op10_lm": op10_lm,
    "op11_centroids": op11_centroids,
    "op12_secrets": op12_secrets,
    "op13_runs": op13_runs,
}

ORACLE_SQL: dict[str, str] = {"op5_urls": urls.ORACLE_SQL, "op6_decontaminate": decontaminate.ORACLE_SQL, "op7_warc": warc.ORACLE_SQL, "op11_centroids": centroids.ORACLE_SQL, "op12_secrets": secret_scan.ORACLE_SQL}
