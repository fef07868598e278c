"""Names of adapter tensors: renames, parts and one name per expert of a fused tensor."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Forms of adapter keys (fixed values).
OLD_ROOT, NEW_ROOT = "base_model.model.model", "base_model.model.backbone"
ADAPTER_KEY = r"^(.+?)\.lora_([AB])(?:\.[^.]+)?\.weight$"
ROOTS = r"^base_model\.(?:model\.)?"
FUSED = r"\.experts\.w([12])"


def backbone_key(key: Column) -> Column:
    return F.replace(key, F.lit(OLD_ROOT), F.lit(NEW_ROOT))


def module_path(key: Column) -> Column:
    """The module of an adapter key without the root of its export style; null for other keys."""
    path = F.regexp_extract(key, ADAPTER_KEY, 1)
    return F.when(path != "", F.regexp_replace(path, ROOTS, ""))


def adapter_side(key: Column) -> Column:
    """A or B; null for other keys."""
    side = F.regexp_extract(key, ADAPTER_KEY, 2)
    return F.when(side != "", side)


def expert_keys(key: Column, experts: Column) -> Column:
    """The names of the experts' own tensors in order, for a fused one; any other key alone. Null for a null key."""
    part = F.regexp_extract(key, FUSED, 1)
    name = F.when(part == "1", "up_proj").otherwise("down_proj")
    stem = F.regexp_replace(key, FUSED, ".experts.{n}.{name}")
    own = F.transform(F.sequence(F.lit(0), F.greatest(experts.cast("int"), F.lit(1)) - 1), lambda i: F.replace(F.replace(stem, F.lit("{n}"), i.cast("string")), F.lit("{name}"), name))
    return F.when(part != "", F.when(experts > 0, own).otherwise(F.array().cast("array<string>"))).when(key.isNotNull(), F.array(key))
