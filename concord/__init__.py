"""Concord: catalogue reconciliation and corpus preparation on Spark."""
