"""Linguistic structure and compressibility of text, as Spark queries over tables of documents."""
