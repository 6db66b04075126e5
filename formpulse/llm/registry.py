"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import licenses, urls
from .bpe import op13_bpe
from .common import Query, prepared
from .decontaminate import op6_decontaminate
from .licenses import op3_licences
from .linededup import op2_line_dedup
from .neardup import op7_minhash
from .packing import op10_packing
from .quality import op5_quality
from .secrets import op4_secrets
from .sharding import op1_sharding
from .spelling import op12_spelling
from .urls import op8_urls
from .warc import op9_warc
from .whitening import op11_whitening


def _prepared(run: Query) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(prepared(spark), sf_dir)

    return query


QUERIES: dict[str, Query] = {f.__name__: _prepared(f) for f in (
    op1_sharding, op2_line_dedup, op3_licences, op4_secrets, op5_quality, op6_decontaminate, op7_minhash,
    op8_urls, op9_warc, op10_packing, op11_whitening, op12_spelling, op13_bpe)}
ORACLE: dict[str, str] = {"op3_licences": licenses.ORACLE, "op8_urls": urls.ORACLE}
