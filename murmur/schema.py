"""The tables of the data model, long and array forms."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType


def _table(**columns) -> StructType:
    return StructType([StructField(n, t) for n, t in columns.items()])


_S, _I, _L, _D, _B = StringType(), IntegerType(), LongType(), DoubleType(), BooleanType()

STATE = _table(param=_S, cell=_I, x=ArrayType(_D))
STATE_LONG = _table(param=_S, cell=_I, member=_L, x=_D)
OBS = _table(report=_I, datatype=_S, comp=_I, d=_D)
PRED = _table(report=_I, datatype=_S, comp=_I, y=ArrayType(_D))
VARIANCE_SPEC = _table(report=_I, datatype=_S, comp=_I, kind=_S, value=_D, floor=_D)
VARIANCE = _table(report=_I, datatype=_S, comp=_I, v=_D)
COVARIANCE = _table(report=_I, datatype=_S, i=_I, j=_I, v=_D)
CONTROLS = _table(param=_S, i=_I, x=_D, lb=_D, ub=_D, var=_D)
LOCALIZATION = _table(datatype=_S, report=_I, param=_S, taper=_S, i=_I, j=_I, k=_I, range=_D, aniso=_D, angle=_D)
MASK = _table(param=_S, cell=_I, datatype=_S, report=_I, comp=_I, rho=_D)
COEFFICIENTS = _table(level=_I, subband=_S, idx=_I, c=_D, noise=_D, keep=_B)
PILLARS = _table(j=_I, i=_I, end=_I, x=_D, y=_D, z=_D)
CORNERS = _table(k=_I, b=_I, j=_I, f=_I, i=_I, r=_I, z=_D)
CELLS = _table(k=_I, j=_I, i=_I, active=_B)
RECORDS = _table(kwd=_S, seq=_I, typ=_S, idx=_I, num=_D, text=_S)
TRACE = _table(iteration=_I, misfit=_D, std=_D, lam=_D, accepted=_B, why=_S)
