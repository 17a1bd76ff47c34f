"""User-defined table functions over partitioned tables."""

from __future__ import annotations

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


class Dialogue:
    """One row for each conversation: its turns and changes of role, and for each role that the call names its turns, characters and last text.

    ``quern_dialogue(table => TABLE(t), conversation => 'conv_id', place => 'turn', roles => 'user,assistant')``. The call decides the columns of the result, and asks for rows
    dealt by conversation in the order of their place. Roles that are not named count in n_turns and n_switches only; null texts have no characters.
    """

    def __init__(self) -> None:
        self.conv, self.before, self.turns, self.switches = None, None, 0, 0
        self.found: dict[str, list] = {}
        self.roles: list[str] = []

    @staticmethod
    def analyze(table: AnalyzeArgument, conversation: AnalyzeArgument, place: AnalyzeArgument, roles: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("the first argument has to be a table")
        names = set(table.dataType.fieldNames())
        if missing := {conversation.value, place.value, "role", "text"} - names:
            raise ValueError(f"the table lacks {sorted(missing)}")
        schema = StructType().add(conversation.value, table.dataType[conversation.value].dataType).add("n_turns", IntegerType()).add("n_switches", IntegerType())
        for role in roles.value.split(","):
            schema = schema.add(f"{role}_turns", IntegerType()).add(f"{role}_chars", LongType()).add(f"{role}_last", StringType())
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn(conversation.value)], orderBy=[OrderingColumn(place.value)])

    def eval(self, table: Row, conversation: str, place: str, roles: str):
        if not self.turns:
            self.conv, self.roles = table[conversation], roles.split(",")
            self.found = {r: [0, 0, None] for r in self.roles}
        self.turns += 1
        self.switches += self.turns > 1 and table["role"] != self.before
        self.before = table["role"]
        if table["role"] in self.found:
            own = self.found[table["role"]]
            own[0] += 1
            own[1] += len(table["text"] or "")
            own[2] = table["text"]

    def terminate(self):
        if self.turns:
            yield (self.conv, self.turns, self.switches, *(x for r in self.roles for x in self.found[r]))


def register(spark: SparkSession) -> None:
    """Makes the table functions known to SQL of a session; rows go over in Arrow batches."""
    spark.udtf.register("quern_dialogue", udtf(Dialogue, useArrow=True))
