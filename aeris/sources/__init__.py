"""Inputs and outputs: table adapters, file scans, manifests, CSV, sinks."""
