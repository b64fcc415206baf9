"""Speech and conversation data operators on Spark DataFrames.

Every operator takes and returns DataFrames; nothing here runs an action except the sinks and the
explicitly named executors (``write_*``, ``export_*``, ``apply_*``).
"""

__version__ = "0.1.0"
