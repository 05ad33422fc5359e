"""strataflow.sources"""
