"""Small frames for the tests."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(*r, *(("en", "s") if len(r) == 2 else ()), None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, SCHEMA)
