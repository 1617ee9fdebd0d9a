"""Files into elements: rows (doc_id, elem_idx, type, text, position, level, extra)."""
