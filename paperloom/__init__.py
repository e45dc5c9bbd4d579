"""paperloom: exam-corpus and assessment analytics as PySpark jobs.

Layers, each using only those above it:

* ``functions``  - column expressions (no I/O, no shuffles)
* ``plans``      - session set-up and scale-safe building blocks
* ``sources``    - readers and writers for files and tables
* ``operators``  - DataFrame -> DataFrame operators
* ``streaming``  - the Structured Streaming forms of four operators
* ``workload``   - the registered queries over the given tables
"""
