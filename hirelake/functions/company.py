"""Company names."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirelake import fixed
from hirelake.functions.words import bind, contains_any


def company_group(
    name: Column,
    groups: Mapping[str, tuple[str, ...]] = fixed.COMPANY_GROUPS,
    legal_suffix: str = fixed.LEGAL_SUFFIX,
) -> Column:
    """Group name: first group with an alias inside the name, else the name
    without its legal suffix words."""

    def group_of(low: Column) -> Column:
        bare = F.trim(F.regexp_replace(low, "(?U)" + legal_suffix, ""))
        bare = F.rtrim(bare, F.lit(",. "))
        result = F.coalesce(F.nullif(bare, F.lit("")), low)
        for group, aliases in reversed(list(groups.items())):
            result = F.when(contains_any(low, aliases), F.lit(group)).otherwise(result)
        return result

    return bind(F.trim(F.lower(name)), group_of)
