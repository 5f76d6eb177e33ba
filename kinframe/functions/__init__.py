"""kinframe.functions"""
