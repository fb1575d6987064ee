"""Joining texts with a delimiter."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The named delimiters.
DELIMITERS = {"double_newline": "\n\n", "single_newline": "\n", "space": " ", "comma": ", "}


@dataclass(frozen=True)
class TextConcatenator:
    """Joins an array of texts, or the texts of a group. Null texts are left out."""

    delimiter: str = DELIMITERS["single_newline"]

    def concate_deol(self) -> TextConcatenator:
        return replace(self, delimiter=DELIMITERS["double_newline"])

    def concate_seol(self) -> TextConcatenator:
        return replace(self, delimiter=DELIMITERS["single_newline"])

    def concate_space(self) -> TextConcatenator:
        return replace(self, delimiter=DELIMITERS["space"])

    def concate_comma(self) -> TextConcatenator:
        return replace(self, delimiter=DELIMITERS["comma"])

    def concate_custom(self, delimiter: str) -> TextConcatenator:
        return replace(self, delimiter=delimiter)

    def join(self, texts: Column) -> Column:
        return F.array_join(texts, self.delimiter)

    def join_group(self, text: Column, *order: Column) -> Column:
        """An aggregate: the group's texts in the given order. Partial lists are gathered before the shuffle."""
        keys = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), text.alias("text"))
        return self.join(F.transform(F.sort_array(F.collect_list(keys)), lambda x: x["text"]))
