"""Schemas of the corpus table and of the raw records it is fed from."""

from pyspark.sql import types as T

VECTOR_DIM = 768

#: The corpus table. Unknown text is null inside the engine; blanks and sentinels live at its edges only.
PAPERS = T.StructType(
    [
        T.StructField("arxiv_id", T.StringType(), False),
        *[T.StructField(n, T.StringType()) for n in ("s2_id", "title", "abstract", "authors")],
        T.StructField("year", T.IntegerType()),
        *[T.StructField(n, T.StringType()) for n in ("submitted_date", "venue")],
        *[T.StructField(n, T.IntegerType()) for n in ("citation_count", "max_author_citations")],
        *[T.StructField(n, T.StringType()) for n in ("fields_of_study", "pdf_url", "arxiv_url", "source", "doi")],
        T.StructField("has_embedding", T.BooleanType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
    ]
)

#: A record of the bulk interface.
RAW_RECORD = T.StructType(
    [
        T.StructField("paperId", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("abstract", T.StringType()),
        T.StructField("authors", T.ArrayType(T.StructType([T.StructField("authorId", T.StringType()), T.StructField("name", T.StringType()), T.StructField("citationCount", T.IntegerType())]))),
        T.StructField("year", T.IntegerType()),
        T.StructField("publicationDate", T.StringType()),
        T.StructField("venue", T.StringType()),
        T.StructField("citationCount", T.IntegerType()),
        T.StructField("url", T.StringType()),
        T.StructField("externalIds", T.StructType([T.StructField("ArXiv", T.StringType())])),
        T.StructField("openAccessPdf", T.StructType([T.StructField("url", T.StringType())])),
        T.StructField("s2FieldsOfStudy", T.ArrayType(T.StructType([T.StructField("category", T.StringType())]))),
    ]
)
