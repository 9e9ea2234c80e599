"""Lookups and settings as data."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

# Collections by category of an entity dump.
COLLECTIONS = {
    "items": "items", "recipes": "recipes", "mobs": "mechanics", "crops": "mechanics", "skills": "mechanics", "weather": "mechanics",
    "maps": "web_pages", "building": "items", "vehicles": "items", "achievements": "mechanics", "poi": "web_pages", "traps": "items",
    "weapons_melee": "items", "weapons_firearms": "items", "ammunition": "items", "clothing": "items", "food": "items",
    "medication": "items", "tools": "items", "electronics": "items", "containers": "items", "furniture": "items",
}
DEFAULT_COLLECTION = "web_pages"
# Rows that a full corpus has per category.
EXPECTED_TOTALS = {
    "items": 350, "recipes": 250, "mobs": 30, "skills": 42, "crops": 25, "weather": 50, "maps": 12, "building": 60, "vehicles": 35,
    "achievements": 75, "traps": 10,
}
# Type of a file by extension.
FILE_TYPES = {
    "txt": "text", "md": "markdown", "rst": "text", "log": "text", "csv": "csv", "json": "json", "xml": "xml",
    "html": "html", "htm": "html", "java": "java", "lua": "lua", "pdf": "pdf", "docx": "docx", "epub": "epub",
    "zip": "archive", "jar": "archive", "png": "image", "jpg": "image", "jpeg": "image", "wav": "audio",
    "mp3": "audio", "ogg": "audio", "mp4": "video", "mkv": "video", "ini": "config", "cfg": "config", "conf": "config",
    "yml": "config", "yaml": "config", "toml": "config", "tile": "text", "tiles": "text", "frag": "text", "vert": "text",
    "gif": "image", "bmp": "image", "webp": "image", "tif": "image", "tiff": "image", "svg": "image",
    "flac": "audio", "m4a": "audio", "avi": "video", "webm": "video",
}
MIME_TYPES = {
    "text": "text/plain", "markdown": "text/markdown", "csv": "text/csv", "json": "application/json", "xml": "application/xml",
    "html": "text/html", "java": "text/x-java", "lua": "text/x-lua", "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "epub": "application/epub+zip",
    "archive": "application/zip", "image": "image/*", "audio": "audio/*", "video": "video/*", "config": "text/plain",
}
#: Folders that a scan passes over.
SKIPPED_FOLDERS = ("backup", ".git", "quarantine", "__pycache__")
# Collections that a message's intent looks in.
INTENT_COLLECTIONS = {
    "stats": ["items"], "survival": ["mechanics", "items"], "recipe": ["recipes", "mechanics"], "moddoc": ["lua_api", "java_api"],
    "search": ["items", "recipes", "mechanics", "lua_api", "java_api"],
}
# The enumerations of the relational tables, and what metadata may hold.
ENUMS = {
    "agent_status": ["pending", "planning", "building", "validating_l1", "validating_l2", "validating_l3", "validating_l4", "fixing", "packaging", "done", "failed", "escalated", "cancelled"],
    "validation_level": ["l1_static", "l2_boot", "l3_runtime", "l4_functional"],
    "validation_result": ["passed", "failed", "warning", "error", "skipped"],
    "governance_tier": ["green", "orange", "red"],
    "build_target": ["build41", "build42", "both"],
    "publish_status": ["draft", "review", "approved", "published", "deprecated"],
    "dependency_type": ["requires", "recommends", "suggests", "conflicts", "provides"],
    "role": ["admin", "developer", "reviewer", "viewer"],
    "run_status": ["pending", "running", "done", "failed", "partial"],
    "game_version": ["b41", "b42"],
    "item_type": ["item", "weapon", "food", "drink", "clothing", "tool", "medication", "vehicle_part", "ammo", "component", "plant", "meat", "fish"],
}
# Extensions that a scan of game files passes over.
SKIPPED_EXTENSIONS = [
    "exe", "dll", "jar", "bat", "cmd", "bin", "png", "jpg", "jpeg", "gif", "bmp", "webp", "tiff", "tif", "svg", "psd", "xcf", "blend", "glb", "wav",
    "ogg", "mp3", "flac", "m4a", "mkv", "avi", "mov", "webm", "wmv", "fbx", "animstates", "x", "sfk", "pak", "lotpack", "lotheader", "lbc", "bk2", "dat",
]
# When a run goes to a human.
MAX_RETRIES = 5
ESCALATING = ["syntax_error_after_5_retries", "runtime_crash_after_5_retries", "api_misuse_detected", "security_policy_violation", "dependency_conflict_unresolvable"]
CORE_FILES, PROPRIETARY = "mod_modifies_core_game_files", "dependency_on_proprietary_mod"
HUMAN = ["new_mod_requires_workshop_upload", CORE_FILES, "external_api_key_required", PROPRIETARY]


@dataclass
class Settings:
    chunk_size: int = 512
    chunk_overlap: int = 64
    recall_threshold: float = 0.75
    recall_k: int = 5
    batch_bytes: int = 10 * 1024 * 1024
    retention_staging: int = 5
    retention_production: int = 10
    stale_hours: int = 48
    default_version: str = "b41"
    #: Characters that are kept of a text in an archive; 0 keeps all.
    member_chars: int = 10_000


def parse_settings(text: str) -> dict[str, str]:
    """key=value lines; comments and blank lines are skipped, the first ``=`` splits, quotes around values go."""
    out = {}
    for line in text.splitlines():
        line = line.strip()
        if line and not line.startswith(("#", ";")) and "=" in line:
            key, _, value = line.partition("=")
            out[key.strip()] = value.strip().strip("\"'")
    return out


def load_settings(text: str = "", environment: dict[str, str] | None = None, prefix: str = "LODESTRATA_") -> Settings:
    """Defaults, then the text, then the environment; unknown keys are ignored, later ones win."""
    environment = dict(os.environ) if environment is None else environment
    found = {k.lower(): v for k, v in parse_settings(text).items()}
    found |= {k[len(prefix) :].lower(): v for k, v in environment.items() if k.startswith(prefix)}
    out = Settings()
    for f in fields(Settings):
        if f.name in found:
            setattr(out, f.name, type(getattr(out, f.name))(found[f.name]))
    return out


def current_version(environment: dict[str, str], file_text: str | None, default: str = Settings.default_version) -> str:
    """The data version: from the environment, else a version file's first line, else the default; trimmed, lower case."""
    for value in (environment.get("DATA_VERSION"), (file_text or "").strip().splitlines()[0] if (file_text or "").strip() else None):
        if value and value.strip():
            return value.strip().lower()
    return default
