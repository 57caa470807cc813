"""Run status codes."""

# Codes and labels of the run ledger.
RUNNING = 1
STOPPING = 2
FINISHED = 3
ERROR = 4
REQUIRES_INTERACTION = 5
INTERACTING = 6
STOPPED = 7
UNKNOWN = 8

LABELS = {
    RUNNING: "Running",
    STOPPING: "Stopping...",
    FINISHED: "Finished",
    ERROR: "Error",
    REQUIRES_INTERACTION: "Requires interaction",
    INTERACTING: "Interacting...",
    STOPPED: "Stopped",
    UNKNOWN: "Unknown",
}

# a run that was under way when the ledger was last written can no longer be
UNDER_WAY = (RUNNING, STOPPING, REQUIRES_INTERACTION, INTERACTING)
