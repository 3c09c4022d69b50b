"""tracelake: a PySpark-native engine for agent-session logs and training-data pipelines."""
