"""From a feature dictionary to a Spark schema and back to names."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"float32": T.FloatType(), "float64": T.DoubleType(), "int64": T.LongType(), "int32": T.IntegerType(), "int16": T.ShortType(), "int8": T.ByteType(), "uint8": T.ShortType(), "bool": T.BooleanType(), "string": T.StringType()}


def schema_of(features: dict[str, dict]) -> T.StructType:
    """Shape (1,) is a scalar, one to five dims are nested arrays with the length of a vector in its metadata, an image is
    binary, a video has no column; anything else raises ValueError."""
    fields = []
    for name, spec in features.items():
        shape = tuple(spec.get("shape", (1,)))
        if "/" in name:
            raise ValueError(f"a feature name can't hold /: {name}")
        if spec["dtype"] == "video":
            continue
        if spec["dtype"] == "image":
            fields.append(T.StructField(name, T.BinaryType()))
            continue
        if spec["dtype"] not in _TYPES or not 0 <= len(shape) <= 5:
            raise ValueError(f"not a type and shape for a feature: {name} {spec}")
        kind: T.DataType = _TYPES[spec["dtype"]]
        if shape != (1,) and spec["dtype"] != "string":
            for _ in shape:
                kind = T.ArrayType(kind)
        fields.append(T.StructField(name, kind, True, {"length": shape[0]} if len(shape) == 1 and shape != (1,) else {}))
    return T.StructType(fields)


def features_of(schema: T.StructType) -> dict[str, dict]:
    """Floating numbers and vectors of them as float32, all others as int64; a length is in a field's metadata."""
    out = {}
    for f in schema.fields:
        kind = f.dataType
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        dtype = "string" if isinstance(kind, T.StringType) else "float32" if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)) else "int64"
        out[f.name] = {"dtype": dtype, "shape": (f.metadata.get("length", 1),)}
    return out
