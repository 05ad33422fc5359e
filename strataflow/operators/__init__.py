"""strataflow.operators"""
