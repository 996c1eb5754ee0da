"""Schemas of the engine's tables."""

from __future__ import annotations

LOOSE_IDS = "oid string, path string"
PACKS = "pack_id string, idx_version int, pack_version int, num_objects bigint, idx_path string, pack_path string, pack_size bigint"
PACK_ENTRIES = "pack_id string, idx_pos bigint, oid string, offset bigint, crc32 bigint"
PACK_HEADERS = PACK_ENTRIES + ", phys_type string, inflated_size bigint, data_start bigint, base_offset bigint, base_ref string, pack_path string"
PACK_CHAINS = PACK_HEADERS + ", base_at bigint, root_offset bigint, depth bigint, type string, base_oid string"
LOOSE_HEADERS = "oid string, type string, size bigint, path string"
LOOSE_OBJECTS = "oid string, type string, size bigint, payload binary, path string"
OBJECTS = "oid string, type string, size bigint, payload binary, store string, path string, pack_id string, offset bigint"
KINDS = {"ids": LOOSE_IDS, "packs": PACKS, "entries": PACK_ENTRIES, "headers": PACK_HEADERS, "chains": PACK_CHAINS, "loose_headers": LOOSE_HEADERS, "loose": LOOSE_OBJECTS}
