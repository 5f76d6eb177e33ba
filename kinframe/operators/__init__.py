"""kinframe.operators"""
