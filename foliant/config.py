"""Settings from the environment or any mapping."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

TRUE = {"1", "true", "yes", "y"}


def flag(value: str) -> bool:
    return value.strip().lower() in TRUE


def names(value: str) -> tuple[str, ...]:
    return tuple(filter(None, map(str.strip, value.split(","))))


@dataclass(frozen=True)
class Settings:
    """What a run can be told; the defaults are those in use."""

    current_book: str = "sinh_hoc_12"
    super_admin_email: str = ""
    keys: tuple[str, ...] = ()
    chunk_max_chars: int = 3500
    include_out_of_toc_pages: bool = False
    objective_scan_pages: int = 2
    force_metadata_reextract: bool = True
    force_reocr: bool = False
    pdf_dpi: int = 220
    crop_padding: int = 4
    key_group_size: int = 3
    group_sleep: int = 180
    all_keys_exhausted_sleep: int = 3600
    json_retry_count: int = 2
    transient_retry_count: int = 3
    skip_chunk_on_json_error: bool = True
    embedding_batch_size: int = 3
    enable_answer_verify: bool = True
    chatbot_temperature: float = 0.1
    verify_temperature: float = 0.0

    @classmethod
    def read(cls, env: Mapping[str, str] | None = None, prefix: str = "FOLIANT_") -> Settings:
        """Settings from ``env`` by their names in capitals behind ``prefix``; what isn't there is at its default, what isn't of its type is an error."""
        env = os.environ if env is None else env
        read = {"bool": flag, "int": int, "float": float, "str": str, "tuple[str, ...]": names}
        found = {n: env[prefix + n.upper()] for n in cls.__dataclass_fields__ if prefix + n.upper() in env}
        return cls(**{n: read[cls.__dataclass_fields__[n].type](v) for n, v in found.items()})
