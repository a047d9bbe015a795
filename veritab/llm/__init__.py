"""Operations of a large-scale training-data pipeline, each on whole Spark tables.

Nothing outside this subpackage imports it.
"""
