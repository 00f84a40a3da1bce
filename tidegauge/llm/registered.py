"""The queries of this subpackage by name."""

from __future__ import annotations

from . import bpe, html, langid, lines, minhash, mixing, neighbours, repair, repeats, secrets, trie, vectors, warc


def queries() -> dict:
    return {
        "op1_language_id": langid.op1_language_id,
        "op2_line_dedup": lines.op2_line_dedup,
        "op3_minhash_near_dedup": minhash.op3_minhash_near_dedup,
        "op4_mixing": mixing.op4_mixing,
        "op5_byte_bpe": bpe.op5_byte_bpe,
        "op6_html_extraction": html.op6_html_extraction,
        "op7_secret_scan": secrets.op7_secret_scan,
        "op8_nearest_neighbours": neighbours.op8_nearest_neighbours,
        "op9_embedding_near_dedup": vectors.op9_embedding_near_dedup,
        "op10_repeated_passages": repeats.op10_repeated_passages,
        "op11_warc": warc.op11_warc,
        "op12_prefix_trie": trie.op12_prefix_trie,
        "op13_structure_repair": repair.op13_structure_repair,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": lines.OP2_SQL, "op3_minhash_near_dedup": minhash.OP3_SQL, "op4_mixing": mixing.OP4_SQL, "op9_embedding_near_dedup": vectors.OP9_SQL, "op10_repeated_passages": repeats.OP10_SQL, "op11_warc": warc.OP11_SQL, "op12_prefix_trie": trie.OP12_SQL, "op13_structure_repair": repair.OP13_SQL}


def pipeline(spark, sf_dir):
    """The stages of corpus_pipeline.py one after the other."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
