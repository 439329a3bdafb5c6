"""tessera: a PySpark-native engine for analysing collections of text and code-like artefacts."""
