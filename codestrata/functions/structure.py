"""Entity extraction as one Arrow column function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import pyparse
from .jsparse import script_entities
from .pyparse import ENTITY_TYPE, FACTS_TYPE, python_entities

SCRIPT_EXTS = [".js", ".ts", ".jsx", ".tsx"]


def extract_entities(ext: Column, content: Column) -> Column:
    """Array of entities of a file; an unknown suffix gives null."""

    @F.pandas_udf(ENTITY_TYPE)
    def entities(suffix: pd.Series, source: pd.Series) -> pd.Series:
        readers = {".py": python_entities} | dict.fromkeys(SCRIPT_EXTS, script_entities)
        return pd.Series(
            [readers[x](s) if s is not None and x in readers else None for x, s in zip(suffix, source)], dtype=object
        )

    return entities(ext, content)


def parse_code(ext: Column, language: Column, content: Column) -> Column:
    """Struct of a file's ``facts`` (Python only) and ``entities``, from one parse; null parts where there is nothing to tell."""

    @F.pandas_udf(f"struct<facts:{FACTS_TYPE},entities:{ENTITY_TYPE}>")
    def structure(suffix: pd.Series, lang: pd.Series, source: pd.Series) -> pd.DataFrame:
        facts, entities = [], []
        for x, kind, text in zip(suffix, lang, source):
            tree = fact = found = None
            if text is not None and kind == "python":
                tree, fact = pyparse.parsed(text)
                fact = fact if tree is None else pyparse.with_sizes(tree, fact)
            if text is not None and x == ".py":
                found = [] if tree is None else pyparse.tree_entities(tree, text)
            elif text is not None and x in SCRIPT_EXTS:
                found = script_entities(text)
            facts.append(fact)
            entities.append(found)
        return pd.DataFrame({"facts": facts, "entities": entities}, dtype=object)

    return structure(ext, language, content)
