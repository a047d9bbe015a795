from veritab.model import PARAGRAPHS


def rows_of(*texts, doc="D1", kind="PROSE", doc_type="SAP", section="1.1", heading="Design", seq=0, lines=None, first=0):
    return [
        (doc, doc_type, doc, "v1.0", "A. Author", section, heading, f"{section}-p{first + i + 1}", 12, 14, t, lines if lines is not None else t.split("\n"), kind, seq, 1, first + i + 1)
        for i, t in enumerate(texts)
    ]


def paragraphs(spark, rows):
    return spark.createDataFrame(rows, PARAGRAPHS).coalesce(4)
