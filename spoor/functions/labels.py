"""Names of entities: label cleaning and expected labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffix and the markers that set a variant of an entity
# apart from the entity itself, in order of precedence.
COMPACT_SUFFIX = "_compact"
VARIANT_MARKERS = ("_test_", "_loo_", "_family_", "_ipbits")


def clean_label(name: Column) -> Column:
    """Strip the suffix, then cut at the first marker that occurs in the name.

    An earlier alternative of the pattern is tried over the whole name before the
    next one, which gives the markers their precedence.
    """
    base = F.regexp_replace(name, COMPACT_SUFFIX + r"\z", "")
    heads = "|".join(f"(.*?){marker}" for marker in VARIANT_MARKERS)
    groups = "".join(f"${i + 1}" for i in range(len(VARIANT_MARKERS)))
    return F.regexp_replace(base, rf"(?s)^(?:{heads}).*\z", groups)


def file_stem(path: Column) -> Column:
    """Last part of a path without its extension; a leading dot is no extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]+$", "")


def expected_label(relative_path: Column) -> Column:
    """The first folder names the entity if there is one, else the file stem does."""
    return clean_label(
        F.when(relative_path.contains("/"), F.substring_index(relative_path, "/", 1)).otherwise(
            file_stem(relative_path)
        )
    )
