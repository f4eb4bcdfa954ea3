"""Request parameters used by the registered queries (same values in the oracle SQL)."""

# small chunking parameters: most documents get several chunks
SMALL = dict(min_size=64, avg_size=512, max_size=4096, mask_bits=9)

LAST_SYNC_TIME = 500          # J3: the client's last sync (seconds)
MODIFIED_SINCE = 500          # P1
RESOLVED_AT = 1700000000      # F6/F7: resolution time, unix seconds (UTC)
FINALIZED_AT = 1700000000     # S6: finalisation time, unix seconds
AS_OF = "2024-02-01 00:00:00"  # A10: throughput read-out time (UTC)
TOKEN_RATE = 1                # T4: bytes per second
TOKEN_BURST = 100000          # T4: bucket size in bytes
FP_WINDOW = 48                # C3 window in bytes
SWITCH = 200                  # P7: the chunker's switch point as a parameter
SERVER_TIME = 1700000000      # the sync response's clock, unix seconds
TOMBSTONE_LANG = "es"         # P2: the client deletes its Spanish documents
