"""The queries of this package, over the tables of a folder, and their SQL where SQL can say them."""

from pyspark.sql import DataFrame, SparkSession

from . import ann, chat, html_extract, langid, mixing, neardup_embedding, packing, pii, sharding, simhash
from ._common import table


def _over(name: str, operator):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(table(spark, sf_dir, name))

    return query


def queries() -> dict:
    return {
        "op1_language_id": _over("documents", langid.identify),
        "op2_nearest_neighbours": _over("embeddings", ann.contract),
        "op3_source_mixing": _over("documents", mixing.contract),
        "op4_personal_data": _over("documents", pii.contract),
        "op5_chat_format": _over("conversations", chat.contract),
        "op6_embedding_near_dedup": _over("embeddings", neardup_embedding.contract),
        "op7_simhash_near_dedup": _over("documents", simhash.contract),
        "op8_packing": _over("documents", packing.contract),
        "op9_html_extraction": _over("pages", html_extract.contract),
        "op10_sharding": _over("documents", sharding.contract),
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_source_mixing": mixing.ORACLE, "op5_chat_format": chat.ORACLE}
