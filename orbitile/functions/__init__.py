"""Scalar functions: functions from Column to Column."""
