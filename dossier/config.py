"""Settings of the ingest side."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path

FALLBACK_AGENT = "dossier research contact@localhost"


@dataclass(frozen=True)
class Config:
    root: str
    user_agent: str = FALLBACK_AGENT
    requests_per_second: float = 5.0

    @property
    def raw_dir(self) -> str:
        return f"{self.root}/raw"

    @property
    def tables(self) -> str:
        return f"{self.root}/tables"

    @classmethod
    def load(cls, root: str) -> Config:
        """From the environment, and from a .env file beside the data where there is one."""
        values = dict(os.environ)
        env = Path(root) / ".env"
        if env.exists():
            pairs = [line.split("=", 1) for line in env.read_text().splitlines() if "=" in line and not line.lstrip().startswith("#")]
            values = {k.strip(): v.strip().strip("'\"") for k, v in pairs} | values
        agent = values.get("SEC_USER_AGENT", "").strip()
        Path(root).mkdir(parents=True, exist_ok=True)
        return cls(root, FALLBACK_AGENT if not agent or "example.com" in agent else agent)
