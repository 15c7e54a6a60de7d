"""Registered queries of the subpackage: name -> (DataFrame builder, SQL text or None)."""

from touchline.llm import covertree, curriculum, forest, htmltext, lines, packing, phrases, secrets, simhash, slots, toxicity, vafile, vectorfit

QUERIES = {
    "op1_cost_packing": (packing.op1_cost_packing, None),
    "op2_curriculum": (curriculum.op2_curriculum, curriculum.OP2_SQL),
    "op3_cover_tree": (covertree.op3_cover_tree, covertree.OP3_SQL),
    "op4_layout_text": (htmltext.op4_layout_text, None),
    "op5_simhash_trie": (simhash.op5_simhash_trie, None),
    "op6_line_bitmaps": (lines.op6_line_bitmaps, lines.OP6_SQL),
    "op7_subword_toxicity": (toxicity.op7_subword_toxicity, None),
    "op8_projection_forest": (forest.op8_projection_forest, None),
    "op9_virtual_slots": (slots.op9_virtual_slots, None),
    "op10_assignment_secrets": (secrets.op10_assignment_secrets, None),
    "op11_vector_best_fit": (vectorfit.op11_vector_best_fit, None),
    "op12_vafile_clusters": (vafile.op12_vafile_clusters, vafile.OP12_SQL),
    "op13_phrase_collocations": (phrases.op13_phrase_collocations, phrases.OP13_SQL),
}
