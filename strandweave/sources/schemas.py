"""Record types of reference structures and sequence graphs as Spark schemas.

A union with null is a nullable column; an allele, an int or a string, is two
nullable columns of which one is set. Faces are the strings LEFT and RIGHT.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


LONG, INT, TEXT, REAL = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType()


def record(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


SIDE = record(coordinate=LONG, face=TEXT)
EDGE = record(id=LONG, left=LONG, right=LONG)
BLOCK = record(start=LONG, length=LONG)
SITE = record(edge=EDGE, bases=TEXT)
BREAKPOINT = record(edge=EDGE)
GENERALIZATION = record(lowerStart=LONG, upperStart=SIDE, length=LONG)
PLOIDY_BOUNDS = record(lower=INT, upper=INT, variable=TEXT)
ALLELE_GROUP = record(edge=EDGE, allele_int=INT, allele_string=TEXT, ploidy=PLOIDY_BOUNDS, genome=TEXT)
SG_ADJACENCY = record(edge=EDGE, ploidy=PLOIDY_BOUNDS, genome=TEXT)
ANCHOR = SG_ADJACENCY
TRANSMISSION = record(parent=LONG, child=LONG, ploidy=PLOIDY_BOUNDS)
TERM = record(variable=TEXT, weight=REAL)
CONSTRAINT = record(terms=T.ArrayType(TERM), limit=INT)


def checked_faces(df: DataFrame, column: str = "face") -> DataFrame:
    """Rows as they are; a face other than LEFT and RIGHT raises."""
    c = F.col(column)
    bad = F.raise_error(F.concat(F.lit("no face: "), c))
    return df.withColumn(column, F.when(c.isNull() | c.isin("LEFT", "RIGHT"), c).otherwise(bad))


def flat_edges(df: DataFrame, kind: str) -> DataFrame:
    """(kind, id, left_side, right_side) of records with an ``edge``."""
    return df.select(F.lit(kind).alias("kind"), F.col("edge.id").alias("id"), F.col("edge.left").alias("left_side"), F.col("edge.right").alias("right_side"))
