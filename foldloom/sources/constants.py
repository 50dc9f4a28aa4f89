"""Settings of the two studies the engine was made for. Operators take them as parameters."""

# Channel order, sampling rate, samples per segment.
CHANNELS = ("FP1-F7", "P3-O1", "P4-O2", "FP2-F8", "P8-O2", "FZ-CZ", "CZ-PZ", "P7-T7")
SAMPLING_RATE = 256
N_SAMPLES = 2560
# Expected class counts of the full segment export.
EXPECTED_COUNTS = {"total": 2053, "negative": 1039, "positive": 1014}
# Recording folders that belong to the person of another folder.
SAME_PERSON = {"chb21": "chb01", "chb17a": "chb17", "chb17b": "chb17"}
# Required metadata columns of a segment export.
REQUIRED_METADATA = ("segment_id", "patient", "subject", "label", "signal_sha256")
# The five recording sets in load order, and the folder names each may have.
RECORDING_SETS = {"Z": ("Z", "A", "Set_Z"), "O": ("O", "B", "Set_O"), "N": ("N", "C", "Set_N"),
                  "F": ("F", "D", "Set_F"), "S": ("S", "E", "Set_S")}
RECORDING_LENGTHS = (4096, 4097)
# Names and suffixes that a file scan skips.
SKIPPED_NAMES = (".DS_Store", "Thumbs.db", "desktop.ini", "__MACOSX", "__pycache__", ".ipynb_checkpoints",
                 ".git", ".pytest_cache")
SKIPPED_SUFFIXES = (".pyc", ".pt", ".pth")
