"""Keyword rules and name lists for tagging signals. Fixed values throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evigraph.functions.values import contains_any

# Rule id -> (keywords, roles).
RULES: dict[str, tuple[list[str], list[str]]] = {
    "R1": (
        ["debug", "dbg", "jtag", "dmi", "tap", "test", "scan", "sba", "halt", "resume", "auth", "password", "pass", "unlock"],
        ["auth_state", "debug_interface", "external_access", "test_access"],
    ),
    "R2": (
        ["lock", "locked", "reglk", "lck", "sticky", "write_once", "protect", "protected", "wr_protect"],
        ["lock_state", "write_protection"],
    ),
    "R3": (
        ["reset", "rst", "clear", "init", "default"],
        ["lifecycle_state", "reset_sensitive_state", "state_residue_risk"],
    ),
    "R4": (
        ["csr", "regfile", "mmio", "apb", "axi", "ahb", "cfg", "config", "ctrl", "control", "status", "mask", "pending",
         "clint", "plic", "uart", "gpio", "rom", "bootrom"],
        ["csr_register", "mmio_register", "peripheral_register", "register_interface", "resource_like"],
    ),
    "R5": (
        ["key", "secret", "fuse", "aes", "hmac", "sha", "rsa", "crypto", "rng", "random", "plaintext", "ciphertext", "hash", "digest"],
        ["crypto_state", "fuse_data", "protected_data", "secret_state"],
    ),
    "R6": (
        ["addr_hit", "region_match", "range", "decode", "grant", "allow", "deny", "access_allowed", "slave_sel", "bridge",
         "fabric", "interconnect"],
        ["address_decode", "bus_bridge", "fabric_access", "protected_range"],
    ),
    "R7": (
        ["dma", "pmp", "bounds", "bound", "len", "length", "range_check", "pmp_check", "permit", "start", "end"],
        ["bounds_check", "dma_control", "pmp_check", "transaction_permission"],
    ),
    "R8": (
        ["wrapper", "bridge", "adapter", "top", "peripheral", "reglk", "acct", "lock", "auth", "debug", "access", "allow",
         "grant", "protect", "secure", "priv", "key", "fuse"],
        ["connection_mediation", "cross_module_control", "wrapper_mediation"],
    ),
    "R9": (
        ["priv", "privilege", "mode", "user", "supervisor", "machine", "secure", "nonsecure", "mstatus", "satp", "tvm"],
        ["mode_control", "privilege_state", "secure_state"],
    ),
}

# Names that are no candidates, and the words of each context test.
PURE_RESET_CLOCK = ["clk", "clock", "rst_n", "reset_n", "rst", "reset"]
WEAK_HANDSHAKE = ["valid", "ready", "done", "busy"]
TEMPORARY_NAMES = ["tmp", "temp", "next", "n", "mux_out"]
PLAIN_DATA = ["data", "rdata", "wdata"]
ACCESS_ONLY_NAMES = ["we", "wen", "wr", "rd", "read", "write", "psel", "sel", "enable", "en"]
CONSTANT_PREFIXES = ["DBG_", "STATE_", "CMD_", "REG_"]
CRYPTO_CONTEXT = ["rsa", "aes", "hmac", "sha", "crypto", "rng", "fuse"]
CRYPTO_RESOURCES = [
    "msg", "message", "rdata", "wdata", "data", "result", "out", "prime", "encry", "decry", "encrypt", "decrypt",
    "cipher", "plain", "hash", "digest", "nonce", "seed",
]
RESET_CONTEXT = ["rst_wrapper", "rst_ctrl", "reset_controller", "reset_ctrl"]
RESET_CONTROLS = ["start", "rst_id", "rst_mem", "reset_id", "reset_mem"]
DMA_CONTEXT = ["dma", "pmp", "range_check", "pmp_check", "bounds"]
HANDSHAKE_CONTEXT = ["debug", "jtag", "crypto", "dma", "pmp", "lock", "auth", "priv", "key", "fuse", "csr", "mmio"]
RESET_WORDS = ["reset", "rst", "clear", "init", "default"]
RESET_STATE_WORDS = [
    "lock", "auth", "debug", "key", "secret", "valid", "state", "mode", "access", "cfg", "priv", "reglk", "acct",
    "rsa", "aes", "hmac", "sha", "crypto", "rng", "fuse",
]
HIGH_PRIORITY_ROLES = [
    "debug_interface", "lock_state", "reset_sensitive_state", "register_interface", "resource_like",
    "protected_data", "crypto_state", "secret_state", "state_residue_risk",
]


def rule_ids(lowered: Column) -> Column:
    """Ids of the rules with a keyword in the lower-case text, in rule order."""
    return F.array_compact(F.array(*[F.when(contains_any(lowered, words), F.lit(r)) for r, (words, _) in RULES.items()]))


def roles_of(rules: Column) -> Column:
    """All roles of an array of rule ids (unsorted, with repeats)."""
    parts = [
        F.when(F.array_contains(rules, r), F.array(*[F.lit(x) for x in roles])).otherwise(F.array().cast("array<string>"))
        for r, (_, roles) in RULES.items()
    ]
    return F.concat(*parts)


def constant_like(name: Column, kind: Column, decl_raw: Column) -> Column:
    prefixed = F.lit(False)
    for p in CONSTANT_PREFIXES:
        prefixed = prefixed | F.startswith(name, F.lit(p))
    upper = name.rlike("[A-Z]") & ~name.rlike("[a-z]") & F.contains(name, F.lit("_"))
    return (kind == "implicit") & decl_raw.isNull() & (prefixed | upper)


def excluded_name(low: Column, context: Column) -> Column:
    listed = low.isin(*PURE_RESET_CLOCK, *TEMPORARY_NAMES, *PLAIN_DATA, *ACCESS_ONLY_NAMES)
    return listed & ~(contains_any(context, CRYPTO_CONTEXT) & low.isin(*PLAIN_DATA))


def weak_handshake(low: Column, text: Column) -> Column:
    return low.isin(*WEAK_HANDSHAKE) & ~contains_any(text, HANDSHAKE_CONTEXT)


def crypto_resource(low: Column, context: Column) -> Column:
    return contains_any(context, CRYPTO_CONTEXT) & contains_any(low, CRYPTO_RESOURCES)


def reset_control(low: Column, context: Column) -> Column:
    return contains_any(context, RESET_CONTEXT) & (low.isin(*RESET_CONTROLS) | F.startswith(low, F.lit("rst_")))


def reset_related(text: Column) -> Column:
    return contains_any(text, RESET_WORDS) & (contains_any(text, RESET_STATE_WORDS) | contains_any(text, RESET_CONTEXT))
