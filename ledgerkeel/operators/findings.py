"""Finding codes of a ledger state."""

from __future__ import annotations

# Diagnostic codes of a ledger state.
LOCKFILE_PARSE_ERROR = "lockfile-parse-error"
LOCKFILE_VERSION_MISMATCH = "lockfile-version-mismatch"
LOCKFILE_HASH_ALGORITHM_MISMATCH = "lockfile-hash-algorithm-mismatch"
LOCKFILE_CANONICALIZER_MISMATCH = "lockfile-canonicalizer-mismatch"
LOCKFILE_SCHEMA_PATH_MISMATCH = "lockfile-schema-path-mismatch"
LOCKFILE_MIGRATIONS_PATH_MISMATCH = "lockfile-migrations-path-mismatch"
LOCKFILE_CHECKPOINTS_PATH_MISMATCH = "lockfile-checkpoints-path-mismatch"
LOCKFILE_STEP_PATH_INVALID = "lockfile-step-path-invalid"
LOCKFILE_STEP_PATH_MISMATCH = "lockfile-step-path-mismatch"
LOCKFILE_DUPLICATE_MIGRATION = "lockfile-duplicate-migration"
LOCKFILE_DUPLICATE_STEP_INDEX = "lockfile-duplicate-step-index"
LOCKFILE_STEP_INDEX_INVALID = "lockfile-step-index-invalid"
INPUT_PATH_INVALID = "input-path-invalid"
INPUT_PATH_DUPLICATE = "input-path-duplicate"
INPUT_SCHEMA_MISSING = "input-schema-missing"
INPUT_ORPHAN_CHECKPOINT = "input-orphan-checkpoint"
COHERENCE_TARGET_MISMATCH = "coherence-target-mismatch"
COHERENCE_HEAD_INDEX_MISMATCH = "coherence-head-index-mismatch"
COHERENCE_HEAD_CHAIN_MISMATCH = "coherence-head-chain-mismatch"
COHERENCE_SCHEMA_DIGEST_MISMATCH = "coherence-schema-digest-mismatch"
COHERENCE_NEW_IN_INPUT = "coherence-new-in-input"
COHERENCE_MISSING_FROM_INPUT = "coherence-missing-from-input"
COHERENCE_STEP_INDEX_MISMATCH = "coherence-step-index-mismatch"
COHERENCE_STEP_VERSION_MISMATCH = "coherence-step-version-mismatch"
COHERENCE_STEP_SCHEMA_MISMATCH = "coherence-step-schema-mismatch"
COHERENCE_MIGRATION_DIGEST_MISMATCH = "coherence-migration-digest-mismatch"
COHERENCE_CHECKPOINT_MISSING = "coherence-checkpoint-missing"
COHERENCE_CHECKPOINT_MISMATCH = "coherence-checkpoint-mismatch"
COHERENCE_CHAIN_HASH_MISMATCH = "coherence-chain-hash-mismatch"

# The codes that block a replay of the head state.
FATAL = (
    LOCKFILE_PARSE_ERROR,
    LOCKFILE_VERSION_MISMATCH,
    LOCKFILE_HASH_ALGORITHM_MISMATCH,
    LOCKFILE_CANONICALIZER_MISMATCH,
    LOCKFILE_SCHEMA_PATH_MISMATCH,
    LOCKFILE_MIGRATIONS_PATH_MISMATCH,
    LOCKFILE_CHECKPOINTS_PATH_MISMATCH,
    LOCKFILE_STEP_PATH_INVALID,
    LOCKFILE_STEP_PATH_MISMATCH,
    LOCKFILE_DUPLICATE_MIGRATION,
    LOCKFILE_DUPLICATE_STEP_INDEX,
    LOCKFILE_STEP_INDEX_INVALID,
    INPUT_PATH_INVALID,
    INPUT_PATH_DUPLICATE,
    COHERENCE_TARGET_MISMATCH,
)

COHERENCE_PREFIX = "coherence-"

# Fixed value: the file findings about a whole ledger point at.
LEDGER_FILE = "schema.lock.toml"
