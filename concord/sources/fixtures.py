"""Credentials of local test services."""

from __future__ import annotations


def bearer() -> dict[str, str]:
    return {"Authorization": "Bearer test"}
