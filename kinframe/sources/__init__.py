"""kinframe.sources"""
