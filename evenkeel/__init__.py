"""Reconcile two copies of a dataset, rows and schema alike, with Spark DataFrames."""

from evenkeel.options import CompareOptions, RowDiffOptions, ScriptOptions

__all__ = ["CompareOptions", "RowDiffOptions", "ScriptOptions"]
