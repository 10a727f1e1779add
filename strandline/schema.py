"""Spark types of extraction records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVIDENCE = "struct<quote:string>"
SOURCED = f"struct<value:string,evidence:{EVIDENCE}>"
ATTRIBUTE = f"struct<name:string,value:string,evidence:{EVIDENCE}>"
GEOGRAPHY = f"struct<name:string,role:string,evidence:{EVIDENCE}>"
PERIOD = f"struct<text:string,start:string,end:string,evidence:{EVIDENCE}>"
MONEY = f"struct<text:string,currency:string,amount:string,qualifier:string,evidence:{EVIDENCE}>"
MENTION = f"struct<id:string,type:string,name:string,aliases:array<string>,relevance:string,involvement:array<string>,description:string,geographies:array<{GEOGRAPHY}>,attributes:array<{ATTRIBUTE}>,evidence:{EVIDENCE}>"
MATTER = f"struct<id:string,kind:string,authority_ids:array<string>,subject_ids:array<string>,case_numbers:array<{SOURCED}>,legal_provisions:array<{SOURCED}>,description:string,evidence:{EVIDENCE}>"
RELATIONSHIP = f"struct<id:string,subject_id:string,object_id:string,kind:string,predicate:string,period:{PERIOD},status:string,negated:boolean,attributes:array<{ATTRIBUTE}>,evidence:{EVIDENCE}>"
RISK = f"struct<id:string,matter_id:string,authority_ids:array<string>,subject_ids:array<string>,affected_ids:array<string>,type:string,label:string,description:string,status:string,period:{PERIOD},geographies:array<{GEOGRAPHY}>,negated:boolean,attributes:array<{ATTRIBUTE}>,evidence:{EVIDENCE}>"
ACTION = f"struct<id:string,matter_id:string,actor_ids:array<string>,target_ids:array<string>,affected_ids:array<string>,type:string,label:string,description:string,status:string,amount:{MONEY},duration:string,period:{PERIOD},geographies:array<{GEOGRAPHY}>,attributes:array<{ATTRIBUTE}>,evidence:{EVIDENCE}>"
EXTRACTION = f"struct<mentions:array<{MENTION}>,matters:array<{MATTER}>,relationships:array<{RELATIONSHIP}>,risks:array<{RISK}>,actions:array<{ACTION}>>"


def rebuilt(value: Column, kind: T.DataType, at: Callable[[Column, T.DataType, str], Column | None], name: str = "") -> Column:
    """``value`` with every part that ``at`` gives a new value for replaced, at any depth; nulls stay null.

    ``at`` sees the column, its type and its field's name from the outside in,
    and gives None where nothing changes.
    """
    new = at(value, kind, name)
    if new is not None:
        return new
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: rebuilt(x, kind.elementType, at, name))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[rebuilt(value[f.name], f.dataType, at, f.name).alias(f.name) for f in kind.fields]))
    return value


def leaves(value: Column, kind: T.DataType, wanted: Callable[[T.DataType, str], bool], name: str = "") -> Column | None:
    """All wanted parts of ``value`` at any depth, as one array without nulls; None where the type has none."""
    if wanted(kind, name):
        return F.array_compact(F.array(value))
    if isinstance(kind, T.ArrayType):
        inner = [leaves(F.lit(None), kind.elementType, wanted, name)]
        return None if inner[0] is None else F.flatten(F.transform(F.coalesce(value, F.array().cast(kind)), lambda x: leaves(x, kind.elementType, wanted, name)))
    if isinstance(kind, T.StructType):
        found = [x for f in kind.fields if (x := leaves(value[f.name], f.dataType, wanted, f.name)) is not None]
        return F.concat(*found) if found else None
    return None


def record_type() -> T.StructType:
    """The type of an extraction record."""
    return T.DataType.fromDDL(EXTRACTION)
