"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from . import chat, decontamination, embedding_duplicates, languages, mixing, near_duplicates, pages, phrases, quality, runs, sharding, substrings, toxicity
from .common import read_table


def queries():
    return {
        "op1_gear_chunks": lambda spark, d: substrings.repeated_spans(read_table(spark, d, "documents")),
        "op2_nb_toxicity": lambda spark, d: toxicity.toxicity_scores(read_table(spark, d, "documents"), read_table(spark, d, "labels")),
        "op4_line_crf": lambda spark, d: quality.quality_scores(read_table(spark, d, "documents"), read_table(spark, d, "labels")),
        "op3_chat_rotation": lambda spark, d: chat.rotate(read_table(spark, d, "conversations")),
        "op5_jump_sharding": lambda spark, d: sharding.shard_table(read_table(spark, d, "documents")),
        "op6_product_quantisation": lambda spark, d: embedding_duplicates.embedding_duplicate_classes(read_table(spark, d, "embeddings")),
        "op7_html_blocks": lambda spark, d: pages.extract(read_table(spark, d, "pages")),
        "op8_pareto_mixing": lambda spark, d: mixing.mix_table(read_table(spark, d, "documents")),
        "op10_latent_leaks": lambda spark, d: decontamination.leaks(read_table(spark, d, "documents"), read_table(spark, d, "benchmark")),
        "op9_minhash_odd_sketch": lambda spark, d: near_duplicates.near_duplicate_classes(read_table(spark, d, "documents")),
        "op11_kneser_ney": lambda spark, d: languages.language_predictions(read_table(spark, d, "documents")),
        "op13_collocations": lambda spark, d: phrases.collocations(read_table(spark, d, "documents")),
        "op12_periodic_runs": lambda spark, d: runs.run_digests(runs.with_planted_runs(read_table(spark, d, "documents"))),
    }


#: The names that the driver meets.
ORACLE_NAMES = tuple(queries())


def oracle_sql():
    return {"op3_chat_rotation": chat.ROTATE_SQL, "op13_collocations": phrases.COLLOCATIONS_SQL}
